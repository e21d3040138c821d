"""Structured Streaming forms of the bins, sessions and collapses; late events within the watermark count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.session import fresh_dir


def live_sessions(events: DataFrame, keys: Sequence[str], at: str, gap_ms: int = 900_000, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream: every event opens an interval of the gap, overlapping ones merge in state.

    ``at`` is a timestamp of ms precision; an event exactly one gap later still belongs, so the
    interval is a millisecond longer. Rows with a null key or time don't count. An event up to
    ``late`` behind the latest one still joins or bridges sessions; a session is given out once
    the watermark passes its end.
    """
    window = F.session_window(F.col(at), f"{gap_ms + 1} milliseconds")
    known = events.dropna(subset=[*keys, at])
    merged = known.withWatermark(at, late).groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(at).alias("last"), F.min(at).alias("first"))
    return merged.select(*keys, F.unix_millis("first").alias("start_ms"), F.unix_millis("last").alias("end_ms"), "n_events")


def replayed_sessions(spark: SparkSession, rows: DataFrame, keys: Sequence[str], at: str, arrival: str, late: str, gap_ms: int = 900_000, batches: int = 8) -> DataFrame:
    """``live_sessions`` over a table put on as a stream in ``batches`` micro-batches in the order of ``arrival``.

    Runs the stream to its end at once. The batches are folders of the shared place, read one
    file set at a time; a last one holds an event of a key of its own far ahead, which moves the
    watermark past all sessions and isn't given out itself. An empty table gives no session.
    """
    place = fresh_dir(spark, "stream")
    known = rows.dropna(subset=[*keys, at]).select(*keys, at, arrival)
    first, last, end = known.agg(F.min(arrival), F.max(arrival), F.max(at)).first()
    shape = "struct<" + ",".join(f"{n}:{t}" for n, t in known.drop(arrival).dtypes) + ">"
    empty = spark.createDataFrame([], shape)
    if end is None:
        return live_sessions(empty, keys, at, gap_ms, late)
    width = (last - first) // batches + 1
    for k in range(batches):
        part = known.where((F.col(arrival) >= first + k * width) & (F.col(arrival) < first + (k + 1) * width)).drop(arrival)
        part.coalesce(1).write.mode("append").parquet(f"{place}/in")  # one file a batch, as a device's upload is
    ahead = known.limit(1).select(*[F.lit("\uffff").cast(dict(known.dtypes)[k]).alias(k) for k in keys], (F.lit(end) + F.expr(f"INTERVAL {late}") * 2 + F.expr("INTERVAL 1 DAY")).alias(at))
    ahead.coalesce(1).write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema(empty.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    found = live_sessions(stream, keys, at, gap_ms, late)
    query = found.writeStream.format("parquet").outputMode("append").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{place}/out")
    return out.where(F.col(keys[0]) != "\uffff")


def live_counts(events: DataFrame, keys: Sequence[str], at: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per key, kind and window of a stream."""
    return events.withWatermark(at, late).groupBy(*keys, kind, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, kind, F.col("w.start").alias("window_start"), "n")


def live_collapse(fixes: DataFrame, at: str = "at", interval: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Mean position per participant and interval of a stream of fixes."""
    return fixes.withWatermark(at, late).groupBy("participant", F.window(at, interval).alias("w")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n")).select("participant", F.col("w.start").alias("at"), "lat", "lon", "n")
