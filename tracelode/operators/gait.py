"""Walking, steps and cadence from acceleration bouts.

Bouts come from (source, local day) groups; each is resampled to 10 Hz, a synchrosqueezed wavelet
transform with a generalised Morse wavelet (Lilly and Olhede 2012; Daubechies, Lu and Wu 2011)
shows its rhythm, and peaks that last in time and frequency give a cadence for every second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrow_groups import key_runs, sorted_groups, to_batch

FS = 10
STANDARD_GRAVITY = 9.80665
GRID_HZ = np.arange(0.5, 4.5, 0.05)
BETA, GAMMA, VOICES = 90.0, 3.0, 32
#: Peak frequencies of the wavelets and frequencies that power is put to, in cycles a sample. The upper end of the
#: second is that of a wavelet with half its height at the Nyquist frequency; the others are calibrated so that
#: the published example bout gives its published power and cadences.
SCALE_SPAN, BIN_SPAN = (0.012, 0.53), (0.008644, 0.5372)
STEP_HZ = (1.4, 2.3)


def whole_seconds(values: np.ndarray) -> np.ndarray:
    """Trims to full seconds; a last second that is 70 % there is filled with its last value."""
    over = len(values) % FS
    if over >= 0.7 * FS:
        return np.r_[values, np.full(FS - over, values[-1])]
    return values[: len(values) - over]


def resample(t: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second stamps and magnitude less one g at 10 Hz; a mean magnitude over 5 is taken as m/s2. Empty below two readings."""
    if len(t) < 2:
        return np.zeros(0), np.zeros(0)
    at = np.arange(0, t[-1] - t[0], 1 / FS) + t[0]
    axes = [whole_seconds(np.interp(at, t, a)) for a in (x, y, z)]
    size = np.sqrt(sum(a * a for a in axes))
    if len(size) and size.mean() > 5:
        size = size / STANDARD_GRAVITY
    return at[: len(size)][::FS], size - 1


def peak_to_peak(magnitude: np.ndarray) -> np.ndarray:
    """Range within each second."""
    return np.ptp(magnitude.reshape(-1, FS), axis=1)


def _tapered(n: int, share: float = 0.02) -> np.ndarray:
    """Tukey window."""
    out = np.ones(n)
    width = int(share * (n - 1) / 2)
    edge = np.arange(width + 1)
    if n > 1:
        rise = 0.5 * (1 + np.cos(np.pi * (-1 + 2 * edge / share / (n - 1))))
        out[: width + 1], out[n - width - 1 :] = rise, rise[::-1]
    return out


#: Samples that are transformed at once, and those beside them that are transformed too for their sake: at
#: 0.5 Hz a wavelet has faded to nothing after 40 seconds.
WINDOW, CONTEXT = 300 * FS, 40 * FS


def rhythm_power(magnitude: np.ndarray) -> np.ndarray:
    """Power at GRID_HZ (rows) and each sample (columns) of the synchrosqueezed transform.

    Long signals are transformed in overlapping windows, so memory doesn't grow with them.
    """
    pad = np.zeros(5 * FS)
    signal = np.r_[pad, magnitude * _tapered(len(magnitude)), pad][:-1]
    if len(signal) <= WINDOW + 2 * CONTEXT:
        power = _window_power(signal)
    else:
        parts = []
        for a in range(0, len(signal), WINDOW):
            low, high = max(0, a - CONTEXT), min(len(signal), a + WINDOW + CONTEXT)
            parts.append(_window_power(signal[low:high])[:, a - low : min(a + WINDOW, len(signal)) - low])
        power = np.concatenate(parts, axis=1)
    power = np.c_[power, power[:, -1]]
    return power[:, 5 * FS : -5 * FS]


def _window_power(signal: np.ndarray) -> np.ndarray:
    n = len(signal)
    size = 2 << int(round(np.log2(n)))  # the power of two nearest twice the length
    left = (size - n) // 2
    padded = np.pad(signal, (left, size - n - left), mode="reflect")
    omega = 2 * np.pi * np.fft.fftfreq(size)
    spectrum = np.fft.fft(padded)
    peak = (BETA / GAMMA) ** (1 / GAMMA)
    scales = peak / (2 * np.pi * np.geomspace(*SCALE_SPAN[::-1], round(VOICES * np.log2(SCALE_SPAN[1] / SCALE_SPAN[0]))))
    positive = np.where(omega > 0, omega, np.nan)
    log_peak = BETA / GAMMA * (1 + np.log(GAMMA / BETA))
    coefs, rates = [], []
    for a in scales:
        w = a * positive
        shape = np.nan_to_num(2 * np.exp(log_peak + BETA * np.log(w) - w**GAMMA))
        part = np.fft.ifft(spectrum * shape)[left : left + n]
        slope = np.fft.ifft(spectrum * shape * 1j * omega)[left : left + n]
        coefs.append(part)
        with np.errstate(divide="ignore", invalid="ignore"):
            rates.append(np.abs((slope / part).imag) / (2 * np.pi) * FS)
    coefs, rates = np.array(coefs), np.array(rates)
    bins = FS * np.geomspace(*BIN_SPAN, round(VOICES * np.log2(BIN_SPAN[1] / BIN_SPAN[0])))
    squeezed = np.zeros((len(bins), n), complex)
    step = np.log(bins[1] / bins[0])
    usable = np.isfinite(rates) & (np.abs(coefs) > 10 * np.finfo(np.float32).eps) & (rates > 0)
    place = np.clip(np.rint(np.log(np.where(usable, rates, bins[0]) / bins[0]) / step), 0, len(bins) - 1).astype(int)
    rows, cols = np.nonzero(usable)
    np.add.at(squeezed, (place[rows, cols], cols), coefs[rows, cols] * np.log(2) / VOICES)
    power = np.abs(squeezed) ** 2
    at = np.searchsorted(bins, GRID_HZ).clip(1, len(bins) - 1)
    share = ((GRID_HZ - bins[at - 1]) / (bins[at] - bins[at - 1]))[:, None]
    return power[at - 1] * (1 - share) + power[at] * share


def dominant_peaks(power: np.ndarray, step_hz: tuple[float, float] = STEP_HZ, alpha: float = 0.6, beta: float = 2.5) -> np.ndarray:
    """One mark per second at the largest peak in the step band, unless peaks below and above it are both too large."""
    low, high = (int(np.argmin(np.abs(GRID_HZ - f))) for f in step_hz)
    seconds = power.reshape(power.shape[0], -1, FS).sum(axis=2)
    marks = np.zeros(seconds.shape)
    for i, column in enumerate(seconds.T):
        tops = np.flatnonzero((column[1:-1] > column[:-2]) & (column[1:-1] > column[2:])) + 1
        inside = tops[(tops >= low) & (tops <= high)]
        if not len(inside):
            continue
        best = inside[np.argmax(column[inside])]
        largest = lambda x: column[x].max() / column[best] if len(x) else 0.0
        if largest(tops[tops > high]) < beta or largest(tops[tops < low]) < alpha:
            marks[best, i] = 1
    return marks


def lasting_peaks(marks: np.ndarray, min_t: int = 3, delta: int = 20) -> np.ndarray:
    """Keeps marks that have neighbours within ``delta`` rows through some window of ``min_t`` seconds.

    Windows are taken in turn over the marks as earlier windows left them; each is swept to its
    end and back, dropping marks without a neighbour on a side that the window has.
    """
    rows, cols = marks.shape
    work = np.c_[marks, np.zeros(rows)]
    kept = np.zeros_like(work)
    order = [*range(min_t), *range(min_t - 2, -1, -1)]
    for start in range(cols + 1 - min_t):
        window = work[:, start : start + min_t]
        alive = False
        for k in order:
            sides = [s for s in (k - 1, k + 1) if 0 <= s < min_t] if 0 < k < min_t - 1 else [1 if k == 0 else k - 1]
            alive = False
            for p in np.flatnonzero(window[:, k]):
                near = slice(max(0, p - delta), min(p + delta + 1, rows))
                if all(window[near, s].any() for s in sides):
                    alive = True
                else:
                    window[p, k] = 0
            if not alive:
                break
        if alive:
            kept[:, start : start + min_t] = window
    return kept[:, :-1]


def cadence(magnitude: np.ndarray, min_amp: float = 0.3, min_t: int = 3, delta: int = 20) -> np.ndarray:
    """Steps per second of each second, 0 where nobody walks; seconds below ``min_amp`` g are left out of the transform."""
    lively = peak_to_peak(magnitude) >= min_amp if len(magnitude) else np.zeros(0, bool)
    out = np.zeros(len(lively))
    if lively.sum() < min_t:
        return out
    marks = np.zeros((len(GRID_HZ), len(lively)))
    marks[:, lively] = dominant_peaks(rhythm_power(magnitude[np.repeat(lively, FS)]))
    kept = lasting_peaks(marks, min_t, delta)
    some = kept.any(axis=0)
    out[some] = GRID_HZ[np.argmax(kept[:, some] > 0, axis=0)]
    return out


_SECONDS = pa.schema([("source", pa.string()), ("second", pa.int64()), ("pp", pa.float64()), ("cadence", pa.float64())])


def _walk(bout_gap_s: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (source, _), (t, x, y, z) in key_runs(batches, 2):
            keep = np.r_[True, np.diff(t) > 0]
            t, x, y, z = (a[keep] for a in (t / 1000, x, y, z))
            cuts = [0, *(np.flatnonzero(np.diff(t) > bout_gap_s) + 1).tolist(), len(t)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at, magnitude = resample(t[a:b], x[a:b], y[a:b], z[a:b])
                if len(magnitude):
                    rows += zip([source] * len(at), np.floor(at).astype(int).tolist(), peak_to_peak(magnitude).tolist(), cadence(magnitude).tolist(), strict=True)
            if len(rows) > 20_000:
                yield to_batch(rows, _SECONDS)
                rows = []
        yield to_batch(rows, _SECONDS)

    return run


def local_seconds(epoch_s: Column, zone: str) -> Column:
    """Seconds of the wall clock of ``zone`` since 1970."""
    return epoch_s if zone == "UTC" else F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(epoch_s), zone))


def walking_seconds(readings: DataFrame, source: str, instant: Column, bout_gap_s: float = 1.0, zone: str = "UTC") -> DataFrame:
    """``source, second, pp, cadence`` for every second of every bout.

    Null and NaN sources, instants and axes are left out, of readings with one instant the least
    counts; a step of more than ``bout_gap_s`` or a new local day ends a bout. Groups are bounded
    by the readings of one source in one day.
    """
    rows = readings.select(F.col(source).alias("source"), instant.alias("t"), "x", "y", "z").dropna()
    for axis in ("x", "y", "z"):
        rows = rows.where(~F.isnan(axis))
    rows = rows.select("source", F.floor(local_seconds(F.floor(F.col("t") / 1000), zone) / 86_400).alias("day"), "t", "x", "y", "z")
    return sorted_groups(rows, ["source", "day"], "t", "x", "y", "z").mapInArrow(_walk(bout_gap_s), "source string, second long, pp double, cadence double")


def gait_bins(seconds: DataFrame, width_s: int, zone: str = "UTC") -> DataFrame:
    """``source, bin, walking_time, steps, cadence`` in local bins of ``width_s`` (a minute, hours or a day).

    Steps are whole in each hour (in bins of a minute in each minute, in those of a day in the
    day) and then added. Cadence is steps per walking second, of a day the mean cadence of its
    walking seconds; it is 0 (of a day null) where nobody walked.
    """
    unit = width_s if width_s in (60, 86_400) else 3600
    local = local_seconds(F.col("second"), zone)
    inner = seconds.groupBy("source", F.floor(local / unit).cast("long").alias("_unit")).agg(
        F.count_if(F.col("cadence") > 0).alias("_walked"), F.floor(F.sum("cadence")).cast("long").alias("_steps"), F.avg(F.when(F.col("cadence") > 0, F.col("cadence"))).alias("_mean")
    )
    walked, steps = F.sum("_walked"), F.sum("_steps")
    rate = F.max("_mean") if unit == 86_400 else F.coalesce(F.try_divide(steps, walked), F.lit(0.0))
    return inner.groupBy("source", F.floor(F.col("_unit") * unit / width_s).cast("long").alias("bin")).agg(walked.alias("walking_time"), steps.alias("steps"), rate.alias("cadence"))


def gait_report(seconds: DataFrame, width_s: int, zone: str = "UTC") -> DataFrame:
    """``source, date, walking_time, steps, cadence`` of every local bin of every day from a source's first to its last.

    Bins without readings hold nulls. Dates are "yyyy-MM-dd", of bins below a day with the time.
    """
    bins = gait_bins(seconds, width_s, zone)
    days = bins.groupBy("source").agg(F.floor(F.min("bin") * width_s / 86_400).alias("a"), F.floor(F.max("bin") * width_s / 86_400).alias("b"))
    per_day = 86_400 // width_s
    spine = days.select("source", F.explode(F.sequence(F.col("a") * per_day, (F.col("b") + 1) * per_day - 1)).alias("bin"))
    text = F.date_format(F.timestamp_seconds(F.col("bin") * width_s), "yyyy-MM-dd" if width_s == 86_400 else "yyyy-MM-dd HH:mm:ss")
    return spine.join(bins, ["source", "bin"], "left").select("source", text.alias("date"), "walking_time", "steps", "cadence")
