"""Deterministic simulators of logs and location traces; the same seed always gives the same rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.arrow_groups import to_batch
from tracelode.session import pin

DAY_S = 86_400
#: Chance of any contact in each hour of the day.
HOURLY = (0.02, 0.01, 0.01, 0.01, 0.01, 0.02, 0.05, 0.15, 0.3, 0.35, 0.35, 0.4, 0.45, 0.4, 0.35, 0.35, 0.4, 0.45, 0.5, 0.5, 0.45, 0.35, 0.2, 0.1)


def _draw(seed: int, label: str, *keys: Column) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(label), *keys), F.lit(1 << 30)) / float(1 << 30)


def simulate_logs(spark: SparkSession, users: int = 2, days: int = 14, start_s: int = 1_640_995_200, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Calls and texts of ``users`` over ``days``: tables as ``communication_summary`` takes them.

    Each hour holds contacts by the hour's chance and the user's activity; a contact is a call or a
    round of texts in alternating directions with one of the user's phones.
    """
    pin(spark)
    hours = spark.range(users * days * 24).select(F.floor(F.col("id") / (days * 24)).alias("u"), (F.col("id") % (days * 24)).alias("h"))
    chance = F.array(*[F.lit(p) for p in HOURLY])[(F.col("h") % 24).cast("int")]
    busy = 0.5 + _draw(seed, "activity", F.col("u"))
    met = hours.where(_draw(seed, "met", F.col("u"), F.col("h")) < chance * busy)
    keys = (F.col("u"), F.col("h"))
    phone = F.concat(F.lit("phone"), F.floor(_draw(seed, "phone", *keys) ** 2 * 12).cast("string"))
    at = start_s * 1000 + F.col("h") * 3_600_000 + F.floor(_draw(seed, "at", *keys) * 3_000_000)
    base = met.select("u", "h", F.concat(F.lit("user"), F.col("u")).alias("participant"), phone.alias("phone"), at.alias("timestamp"), (_draw(seed, "call", *keys) < 0.3).alias("call"))
    kind = F.array(*map(F.lit, ("Incoming Call", "Outgoing Call", "Missed Call")))[F.floor(_draw(seed, "kind", *keys) * 3).cast("int")]
    length = F.when(kind == "Missed Call", 0.0).otherwise(F.round(-F.log(1 - _draw(seed, "length", *keys)) * 180))
    calls = base.where("call").select("participant", "timestamp", "phone", kind.alias("call_type"), length.alias("duration_s"))
    rounds = base.where("NOT call").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(_draw(seed, "rounds", *keys) * 6).cast("int"))))
    mms = _draw(seed, "mms", *keys, F.col("k")) < 0.05
    sent = (F.col("k") + F.floor(_draw(seed, "first", *keys) * 2)) % 2 == 0
    texts = rounds.select("participant", (F.col("timestamp") + F.col("k") * 45_000).alias("timestamp"), "phone", F.concat(F.when(sent, "sent").otherwise("received"), F.when(mms, " MMS").otherwise(" SMS")).alias("direction"), F.when(mms, "MMS").otherwise((5 + F.floor(_draw(seed, "chars", *keys, F.col("k")) * 120)).cast("string")).alias("message_length"))
    return calls, texts


#: Kinds of outings, vehicles with their usual metres per second, and occupations.
EXITS = ("cafe", "bar", "restaurant", "park", "cinema", "dance", "fitness_centre")
VEHICLES = {"bus": 8.0, "car": 12.0, "bicycle": 5.0, "foot": 1.4}
OCCUPATIONS = ("none", "office", "university")
#: Minutes that an outing of each kind lasts.
STAYS = {"cafe": (20, 80), "bar": (60, 180), "restaurant": (40, 120), "park": (20, 120), "cinema": (100, 160), "dance": (60, 150), "fitness_centre": (45, 100)}
#: Share of the outings that goes to the first, second and third preferred kind; the rest goes to any.
PREFERRED = (0.4, 0.25, 0.15)


@dataclass(frozen=True)
class Attributes:
    """What a simulated person is like; statuses run from 0 (never) to 10 (always)."""

    vehicle: str = "foot"
    main_employment: str = "office"
    active_status: int = 5
    travelling_status: int = 5
    preferred_exits: tuple[str, ...] = ("cafe", "park", "restaurant")

    def __post_init__(self) -> None:
        if self.vehicle not in VEHICLES or self.main_employment not in OCCUPATIONS or not set(self.preferred_exits) <= set(EXITS):
            raise ValueError(f"unknown vehicle, occupation or kind of exit: {self}")
        if not (0 <= self.active_status <= 10 and 0 <= self.travelling_status <= 10) or len(set(self.preferred_exits)) != len(self.preferred_exits) or len(self.preferred_exits) > 3:
            raise ValueError(f"statuses run from 0 to 10 and there are up to three different preferred exits: {self}")


@dataclass(frozen=True)
class Person:
    """Attributes and what changes in them from which day on (0 is the first)."""

    attributes: Attributes
    switches: tuple[tuple[int, str, object], ...] = ()

    def on(self, day: int) -> Attributes:
        changed = {name: value for since, name, value in sorted(self.switches, key=lambda s: s[0]) if since <= day}
        return replace(self.attributes, **{k: tuple(v) if isinstance(v, list) else v for k, v in changed.items()})


def drawn_attributes(rng: np.random.Generator) -> Attributes:
    """Attributes at random."""
    return Attributes(str(rng.choice(list(VEHICLES))), str(rng.choice(OCCUPATIONS)), int(rng.integers(1, 11)), int(rng.integers(1, 11)), tuple(map(str, rng.choice(EXITS, 3, replace=False))))


def people_of(document: dict[str, dict]) -> dict[int, Person]:
    """User number -> person, of a document like ``{"User 1": {"vehicle": "bus"}, "Users 2-4": {"active_status": 6, "active_status-16": 2}}``.

    "name-16" changes an attribute from day 16 on. Attributes that aren't given have their
    defaults; a key without a number is an error.
    """
    out = {}
    for key, given in document.items():
        found = re.search(r"(\d+)(?:-(\d+))?", key)
        if found is None:
            raise ValueError(f"no user number in {key!r}")
        plain = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if "-" not in k}
        switches = tuple((int(k.rsplit("-", 1)[1]), k.rsplit("-", 1)[0], v) for k, v in given.items() if "-" in k)
        for user in range(int(found[1]), int(found[2] or found[1]) + 1):
            out[user] = Person(Attributes(**plain), switches)
    return out


@dataclass(frozen=True)
class Traveller:
    """Where people live, and the sampling of the phone."""

    centre: tuple[float, float] = (42.36, -71.06)
    spread_m: float = 6000.0
    noise_m: float = 4.0
    on_s: int = 120
    off_s: int = 480
    steps_s: int = 5
    bus_stop_m: float = 800.0
    bus_stop_s: int = 20


_FIX = pa.schema([("participant", pa.string()), ("t", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("accuracy", pa.float64())])


def one_trace(user: int, days: int, start_s: int, seed: int, rule: Traveller, person: Person | None = None) -> list[tuple[int, float, float]]:
    """(second, metres north, metres east) of a user; every day begins and ends at home.

    Who has an occupation goes there on weekdays. Outings follow the active status in number and
    the preferred exits in kind, the travelling status in distance. Speeds vary by the leg; a
    bus stops every ``bus_stop_m``.
    """
    rng = np.random.default_rng([seed, user])
    person = person or Person(drawn_attributes(rng))
    spot = lambda scale=0.5: rng.normal(0, rule.spread_m * scale, 2)
    home, work = spot(), spot()
    haunts = {kind: [spot() for _ in range(3)] for kind in EXITS}
    out: list[tuple[int, float, float]] = []

    def stay(where: np.ndarray, until: int, t: int) -> int:
        out.extend((s, *where) for s in range(t, until, rule.steps_s))
        return max(t, until)

    def go(a: np.ndarray, b: np.ndarray, t: int, vehicle: str) -> int:
        corner = np.array([a[0], b[1]])  # along the streets: first east or west, then north or south
        for p, q in ((a, corner), (corner, b)):
            length = float(np.hypot(*(q - p)))
            n = int(length / (VEHICLES[vehicle] * rule.steps_s * rng.uniform(0.85, 1.15))) if length else 0
            stops = set() if vehicle != "bus" or not n else {int(k * rule.bus_stop_m / length * n) for k in range(1, int(length / rule.bus_stop_m) + 1)}
            for k in range(1, n + 1):
                here = p + (q - p) * k / n
                out.append((t, *here))
                t += rule.steps_s
                if k in stops:
                    t = stay(here, t + rule.bus_stop_s, t)
        return t

    def exit_of(now: Attributes) -> str:
        u = rng.random()
        for kind, share in zip(now.preferred_exits, np.cumsum(PREFERRED), strict=False):
            if u < share:
                return kind
        return str(rng.choice(EXITS))

    for day in range(days):
        now = person.on(day)
        midnight = start_s + day * DAY_S
        t = stay(home, midnight + int(rng.uniform(7, 9) * 3600), max(midnight, out[-1][0] + rule.steps_s if out else midnight))
        at = home
        if now.main_employment != "none" and (midnight // DAY_S + 3) % 7 < 5:
            t = stay(work, midnight + int(rng.uniform(16, 18) * 3600), go(at, work, t, now.vehicle))
            at = work
        for _ in range(int(rng.binomial(4, now.active_status / 10))):
            if t > midnight + 20 * 3600:
                break
            kind = exit_of(now)
            nearest_first = sorted(haunts[kind], key=lambda h: float(np.hypot(*(h - at))))
            to = nearest_first[min(int(rng.exponential(now.travelling_status / 10 + 0.05)), 2)]
            t = go(at, to, t, now.vehicle)
            t = stay(to, t + int(rng.uniform(*STAYS[kind]) * 60), t)
            at = to
        t = stay(home, midnight + DAY_S, go(at, home, t, now.vehicle))
    return out


def sampled(t: np.ndarray, rule: Traveller, offset: int) -> np.ndarray:
    """Which seconds the phone records: on and off by turns; the first and last ten minutes always."""
    on = (t + offset) % (rule.on_s + rule.off_s) < rule.on_s
    return on | (t < t[0] + 600) | (t > t[-1] - 600)


def simulate_gps(spark: SparkSession, users: int = 2, days: int = 2, start_s: int = 1_640_995_200, seed: int = 1, rule: Traveller = Traveller(), people: dict[int, Person] | None = None) -> DataFrame:
    """``participant, t, lat, lon, accuracy`` of simulated phones; every user is a task's work of its own.

    ``people`` (``people_of``) states some users' attributes by number from 1; others are drawn.
    """
    lat0, lon0 = rule.centre
    per_degree = 111_195.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for user in batch.column(0).to_pylist():
                path = np.array(one_trace(user, days, start_s, seed, rule, (people or {}).get(user + 1)), float)
                rng = np.random.default_rng([seed, user, 1])
                path = path[sampled(path[:, 0], rule, int(rng.integers(rule.on_s + rule.off_s)))]
                noise = rng.normal(0, rule.noise_m, (len(path), 2))
                lat = lat0 + (path[:, 1] + noise[:, 0]) / per_degree
                lon = lon0 + (path[:, 2] + noise[:, 1]) / per_degree / math.cos(math.radians(lat0))
                accuracy = np.round(rng.gamma(4, 3, len(path)), 3)
                yield to_batch(list(zip([f"user{user}"] * len(path), path[:, 0].astype(int).tolist(), lat.tolist(), lon.tolist(), accuracy.tolist(), strict=True)), _FIX)

    return pin(spark).range(users).repartition(min(users, 200)).mapInArrow(run, "participant string, t long, lat double, lon double, accuracy double")
