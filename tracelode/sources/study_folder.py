"""Readers of study folders: ``study/<participant>/<stream>/[<survey>/]*.csv``."""

from __future__ import annotations

import csv
import os
import struct
import wave
from io import BytesIO, StringIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions.timebins import file_name_epoch, file_name_local
from tracelode.session import pin

#: Columns of each stream as its files name them, with the types read here.
SCHEMAS = {
    "gps": "timestamp long, `UTC time` string, latitude double, longitude double, altitude double, accuracy double",
    "accelerometer": "timestamp long, `UTC time` string, accuracy string, x double, y double, z double",
    "calls": "timestamp long, `UTC time` string, `hashed phone number` string, `call type` string, `duration in seconds` double",
    "texts": "timestamp long, `UTC time` string, `hashed phone number` string, `sent vs received` string, `message length` string, `time sent` long",
    "identifiers": "timestamp long, `UTC time` string",
    "survey_timings": "timestamp long, `UTC time` string, `question id` string, `survey id` string, `question type` string, `question text` string, `question answer options` string, answer string, event string",
    "survey_answers": "`question id` string, `question type` string, `question text` string, `question answer options` string, answer string",
    "power_state": "timestamp long, `UTC time` string, event string, level string",
}
SURVEY_STREAMS = ("survey_timings", "survey_answers", "audio_recordings")


def participants(spark: SparkSession, folder: str) -> list[str]:
    """Sub-folders that are neither hidden nor the registry, sorted; any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [x.getPath().getName() for x in found if x.isDirectory()]
    return sorted(n for n in names if not n.startswith(".") and n != "registry")


def _below(path: Column, folder: str) -> Column:
    """A path without ``folder`` at its head, percent signs resolved."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^.*?" + os.path.basename(folder.rstrip("/")) + "/", "")


def _part(path: Column, folder: str, k: int) -> Column:
    """The k-th part of a path below ``folder``."""
    return F.get(F.split(_below(path, folder), "/"), F.lit(k))


def _place(folder: str, stream: str) -> str:
    return f"{folder.rstrip('/')}/*/{stream}"


def listing(files: DataFrame, path: Column, n_bytes: Column) -> DataFrame:
    """``participant, stream, survey_folder, name, n_bytes, file_s`` of paths ``participant/stream/[survey/]name``.

    Hidden participants, the registry and hidden files are left out; survey_folder is null where
    there is none, file_s where the name states no hour. Other columns are kept.
    """
    parts = F.split(path, "/")
    rows = files.withColumns({"participant": F.get(parts, F.lit(0)), "stream": F.get(parts, F.lit(1)), "survey_folder": F.when(F.size(parts) > 3, F.get(parts, F.lit(2))), "name": F.element_at(parts, -1), "n_bytes": n_bytes})
    hidden = F.startswith("participant", F.lit(".")) | (F.col("participant") == "registry") | F.startswith("name", F.lit("."))
    return rows.where(~hidden).withColumn("file_s", file_name_epoch(F.col("name")))


def stream_files(spark: SparkSession, folder: str, stream: str = "*") -> DataFrame:
    """``listing`` of the data files of a study folder with their ``path``, without reading them."""
    rows = pin(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(_place(folder, stream)).select("path", "length")
    return listing(rows, _below(F.col("path"), folder), F.col("length")).drop("length")


def files_between(files: DataFrame, first: str, last: str) -> DataFrame:
    """Files whose names state an instant from ``first`` to ``last`` (UTC), both included."""
    at = F.timestamp_seconds("file_s")
    return files.where(at.between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))


def file_days(files: DataFrame, zone: str = "UTC") -> DataFrame:
    """``participant, day, n_files``: every local day from a participant's first file to the last, those without files too."""
    dated = files.where(F.col("file_s").isNotNull()).select("participant", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("file_s"), zone)).alias("day")).groupBy("participant", "day").agg(F.count(F.lit(1)).alias("n_files"))
    spine = dated.groupBy("participant").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("participant", F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(dated, ["participant", "day"], "left").select("participant", "day", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def folder_size(files: DataFrame) -> DataFrame:
    """Files and MiB (rounded) per participant."""
    return files.groupBy("participant").agg(F.count(F.lit(1)).alias("n_files"), F.round(F.sum("n_bytes") / 1_048_576, 0).alias("mib"))


def enrolments(identifiers: DataFrame) -> DataFrame:
    """``participant, enrolled_s``: the first stamp of a participant's first identifiers file."""
    first = identifiers.groupBy("participant").agg(F.min(F.struct("file_name", "timestamp")).alias("f"))
    return first.select("participant", (F.col("f.timestamp") / 1000).alias("enrolled_s"))


def read_windows(files: DataFrame, stream: str, start_s: int | None = None, end_s: int | None = None, enrolled: DataFrame | None = None) -> DataFrame:
    """``participant, start_s, end_s`` within which files of ``stream`` are read, the end excluded.

    From enrolment (``enrolled``, else the first identifiers file, else the stream's first file),
    to the last file of any stream but those of surveys, within the asked limits. Participants
    without files of the stream are left out.
    """
    own = F.min(F.when(F.col("stream") == stream, F.col("file_s")))
    begun = F.coalesce(F.min(F.when(F.col("stream") == "identifiers", F.col("file_s"))), own)
    last = F.max(F.when(~F.col("stream").isin(*SURVEY_STREAMS), F.col("file_s")))
    limits = files.where(F.col("file_s").isNotNull()).groupBy("participant").agg(begun.alias("start_s"), last.alias("end_s"), own.alias("_own")).where(F.col("_own").isNotNull()).drop("_own")
    if enrolled is not None:
        limits = limits.join(enrolled, "participant", "left").withColumn("start_s", F.coalesce("enrolled_s", "start_s")).drop("enrolled_s")
    if start_s is not None:
        limits = limits.withColumn("start_s", F.greatest("start_s", F.lit(start_s)))
    return limits if end_s is None else limits.withColumn("end_s", F.least("end_s", F.lit(end_s)))


def in_windows(files: DataFrame, windows: DataFrame) -> DataFrame:
    """Files that begin in their participant's window."""
    return files.join(windows, "participant").where((F.col("file_s") >= F.col("start_s")) & (F.col("file_s") < F.col("end_s"))).drop("start_s", "end_s")


def _any_file(spark: SparkSession, glob: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_stream(spark: SparkSession, folder: str, stream: str, start_s: int | None = None, end_s: int | None = None, windows: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Rows of a stream with ``participant, survey_folder, file_name``, from files stamped in [start, end).

    ``strict`` leaves out files stamped exactly at the start; ``windows`` (``read_windows``) bounds
    each participant's files. Columns are taken by name from each file's header; those a file
    lacks are null. Corrupt files and lines that don't fit give nulls or nothing, never an error;
    a stream that nobody has gives no rows.
    """
    if not _any_file(spark, _place(folder, stream)):
        return rows_of_files(pin(spark).createDataFrame([], "participant string, survey_folder string, name string, value string"), stream)
    lines = pin(spark).read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("ignoreCorruptFiles", "true").text(_place(folder, stream), wholetext=True)
    files = listing(lines.select("value", F.col("_metadata.file_path").alias("path")), _below(F.col("path"), folder), F.lit(None))
    if start_s is not None:
        files = files.where(F.col("file_s") > start_s if strict else F.col("file_s") >= start_s)
    if end_s is not None:
        files = files.where(F.col("file_s") < end_s)
    return rows_of_files(files if windows is None else in_windows(files, windows), stream)


def rows_of_files(files: DataFrame, stream: str) -> DataFrame:
    """The rows of CSV files (participant, survey_folder, name, value) of a stream, typed as ``SCHEMAS`` says."""
    names = [n.strip("`") for n in _names(SCHEMAS[stream])]
    kinds = dict(zip(names, [f.split()[-1] for f in SCHEMAS[stream].split(", ")], strict=True))

    def parse(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(names) + 3)]
            for text, *origin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in _csv_rows(text, names):
                    for column, value in zip(columns, [*row, *origin], strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[*names, "participant", "survey_folder", "file_name"])

    texts = files.where(F.col("value").isNotNull()).select(F.col("value").cast("binary"), "participant", "survey_folder", "name")
    rows = texts.mapInArrow(parse, ", ".join(f"`{n}` string" for n in names) + ", participant string, survey_folder string, file_name string")
    return rows.select("participant", "survey_folder", "file_name", *[F.col(f"`{n}`").try_cast(kinds[n]).alias(n) for n in names])


def timed_survey_rows(timings: DataFrame) -> DataFrame:
    """Rows of survey_timings with ``day_of_week`` (Monday 0) of their UTC time."""
    return timings.withColumn("day_of_week", F.weekday(F.timestamp_millis("timestamp")))


def _csv_rows(content: bytes, names: list[str]) -> list[list[str | None]]:
    """The lines of a CSV text that fit its header, as values of ``names``; nothing from text that isn't CSV."""
    try:
        lines = list(csv.reader(StringIO(content.decode("utf-8-sig"), newline="")))
    except (csv.Error, UnicodeDecodeError):
        return []
    if not lines:
        return []
    places = {name.strip(): i for i, name in enumerate(lines[0])}
    at = [places.get(n) for n in names]
    return [[None if k is None else line[k] or None for k in at] for line in lines[1:] if len(line) == len(lines[0])]


def _names(schema: str) -> list[str]:
    return [f.rsplit(" ", 1)[0] for f in schema.split(", ")]


def survey_answer_files(answers: DataFrame, zone: str = "UTC") -> DataFrame:
    """Rows of survey_answers with the local time of their file, its number per survey, and whether it was submitted.

    A file without a NOT_PRESENTED answer is a submission; one row with event "submitted" is added for it.
    """
    keys = ["participant", "survey_folder", "file_name"]
    timed = answers.withColumn("local_time", file_name_local(F.col("file_name"), zone))
    files = timed.groupBy(*keys).agg(F.min("local_time").alias("local_time"), F.bool_and(F.coalesce(F.col("answer") != "NOT_PRESENTED", F.lit(True))).alias("submitted"))
    files = files.withColumn("file_number", F.row_number().over(Window.partitionBy("participant", "survey_folder").orderBy("local_time", "file_name")))
    rows = timed.join(files.select(*keys, "file_number"), keys).withColumn("event", F.lit(None).cast("string"))
    lines = files.where("submitted").select(*keys, "local_time", "file_number", F.lit("submitted").alias("event"))
    return rows.unionByName(lines, allowMissingColumns=True)


def audio_seconds(content: bytes) -> float | None:
    """Length of a WAV or MP4 recording; None if it can't be told."""
    try:
        if content[:4] == b"RIFF":
            with wave.open(BytesIO(content)) as sound:
                return sound.getnframes() / sound.getframerate()
        at = content.find(b"mvhd")
        if at < 0:
            return None
        wide = content[at + 4] == 1
        scale, length = struct.unpack(">IQ" if wide else ">II", content[at + (24 if wide else 16) : at + (36 if wide else 24)])
        return length / scale
    except (wave.Error, struct.error, EOFError, ZeroDivisionError, IndexError):
        return None


def audio_recordings(spark: SparkSession, folder: str, zone: str = "UTC") -> DataFrame:
    """Three event rows per recording: its start (submission less its length), its submission and its submit line."""
    pin(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_place(folder, "audio_recordings")).where(F.lower("path").rlike(r"\.(wav|mp4)$"))
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    rows = files.select(_part(F.col("path"), folder, 0).alias("participant"), _part(F.col("path"), folder, 2).alias("survey_folder"), name.alias("file_name"), F.pandas_udf(lambda s: s.map(audio_seconds), "double")("content").alias("seconds"))
    rows = rows.withColumn("submit", file_name_local(F.col("file_name"), zone)).where(F.col("submit").isNotNull())
    start = F.timestamp_micros((F.unix_micros("submit") - F.coalesce("seconds", F.lit(0.0)) * 1_000_000).cast("long"))
    three = F.array(F.struct(start.alias("local_time"), F.lit("present").alias("event"), F.lit(0).alias("submit_line")), F.struct(F.col("submit").alias("local_time"), F.lit("present").alias("event"), F.lit(0).alias("submit_line")), F.struct(F.col("submit").alias("local_time"), F.lit("submitted").alias("event"), F.lit(1).alias("submit_line")))
    return rows.select("participant", "survey_folder", "file_name", "seconds", F.inline(three))
