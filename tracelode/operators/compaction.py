"""Many tiny files into few large ones, every record exactly once.

Steps: parse all files once into a staged table; choose one owner (the least file and line) per
record from the keys alone; give the files to a fixed number of output groups, the largest first
to the least loaded; move every record once, to the task of its file's group, which streams it
through pyarrow; check rows and checksum of what was written; then publish a manifest. Groups
follow from the total size and come in shards of ``groups_per_shard``, each with a heap of its
own in its own task, so the listing never meets in one place. A task writes under a passing name
and renames at its end; a repeated attempt replaces a file by an equal one. Readers see only the
run that the manifest names.
"""

from __future__ import annotations

import csv
import heapq
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.session import pin, remove_dir

STORED = "participant string, stream string, record_ms long, utc_time string, fields string"
RECORD_SCHEMA = "file_id long, line_no int, size int, " + STORED
MANIFEST = "shard int, group_id long, file_name string, n_rows long, load long, n_bytes long"
_LINES = re.compile(r"\r\n|\n|\r")
_STORED = pa.schema([("participant", pa.string()), ("stream", pa.string()), ("record_ms", pa.int64()), ("utc_time", pa.string()), ("fields", pa.string())])
#: Characters that a group's writer gathers before it puts out a row group.
ROW_GROUP_CHARS = 8 << 20


def _cells(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter)) if '"' in line else line.split(delimiter)


def _header(line: str) -> tuple[str, list[str]] | None:
    for delimiter in ",;\t|":
        names = [x.strip().lower() for x in _cells(line, delimiter)]
        if len(names) > 1 and ("timestamp" in names or "utc time" in names):
            return delimiter, names
    return None


def _instant(stamp: str, utc: str) -> int | None:
    stamp = stamp.strip()
    if stamp:
        try:
            return int(stamp)
        except ValueError:
            return None
    try:
        when = datetime.fromisoformat(utc.strip())
    except ValueError:
        return None
    when = when.replace(tzinfo=timezone.utc) if when.tzinfo is None else when
    since = when - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1000 + since.microseconds // 1000


def parse_file(content: str | None) -> Iterator[tuple[int, int, str, str, int]]:
    """(line number, instant in ms, UTC time, other fields as JSON, length) of each record of a CSV text.

    Byte-order marks, quoting, any line end, column order and repeated headers are allowed;
    header, blank and broken lines (too few or too many fields, no instant) are no records.
    Null and empty contents have none.
    """
    layout = None
    for number, line in enumerate(_LINES.split((content or "").lstrip("\ufeff"))):
        if not line.strip():
            continue
        if "imestamp" in line or "time" in line.lower():
            if found := _header(line):
                layout = found
                continue
        if layout is None:
            continue
        delimiter, names = layout
        try:
            cells = _cells(line, delimiter)
        except csv.Error:
            continue
        if len(cells) != len(names):
            continue
        row = dict(zip(names, cells, strict=True))
        stamp, utc = row.pop("timestamp", ""), row.pop("utc time", "")
        if (ms := _instant(stamp, utc)) is not None:
            yield number, ms, utc, json.dumps(row, sort_keys=True), len(line)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), pa.int32(), *_STORED.types]
    names = ["file_id", "line_no", "size", *_STORED.names]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for file_id, who, stream, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for number, ms, utc, fields, size in parse_file(content):
                for column, value in zip(columns, (file_id, number, size, who, stream, ms, utc, fields), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read_records(files: DataFrame) -> DataFrame:
    """All records of ``file_id, participant, stream, content``, repeats included, with the length of their lines."""
    return files.select("file_id", "participant", "stream", "content").where(F.col("content").isNotNull()).mapInArrow(_parse, RECORD_SCHEMA)


def _checksum():
    return F.coalesce(F.sum(F.pmod(F.xxhash64("participant", "stream", "record_ms"), F.lit(1 << 31))), F.lit(0))


def owned_lines(records: DataFrame) -> DataFrame:
    """``file_id, n_bytes, n_rows, checksum, lines``: what each file owns of the records.

    Of one (participant, stream, record_ms) the copy of the least file and line counts. Only keys
    and places are moved.
    """
    owner = records.groupBy("participant", "stream", "record_ms").agg(F.min(F.struct("file_id", "line_no", "size")).alias("_o"))
    return owner.groupBy(F.col("_o.file_id").alias("file_id")).agg(
        F.sum("_o.size").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"), _checksum().alias("checksum"), F.collect_list("_o.line_no").alias("lines")
    )


def longest_first(sizes: Sequence[int], groups: int) -> list[int]:
    """Group of each size: the largest goes to the least loaded group first."""
    loads = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for place in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        load, group = heapq.heappop(loads)
        out[place] = group
        heapq.heappush(loads, (load + int(sizes[place]), group))
    return out


class _Group:
    """One output file: gathers rows into large row groups under a passing name."""

    def __init__(self, fs: pyarrow.fs.FileSystem, root: str, group_id: int):
        self.fs, self.group_id, self.n_rows, self.held, self.chars = fs, group_id, 0, [], 0
        self.name = f"group-{group_id:09d}.parquet"
        self.path, self.draft = f"{root}/{self.name}", f"{root}/_{uuid.uuid4().hex}"
        self.writer = pq.ParquetWriter(self.draft, _STORED, filesystem=fs, compression="zstd")

    def add(self, rows: pa.Table, chars: int) -> None:
        self.held.append(rows)
        self.chars += chars
        self.n_rows += rows.num_rows
        if self.chars >= ROW_GROUP_CHARS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.concat_tables(self.held).combine_chunks())
            self.held, self.chars = [], 0

    def close(self) -> int:
        self.flush()
        self.writer.close()
        if (found := pq.read_metadata(self.draft, filesystem=self.fs).num_rows) != self.n_rows:
            raise OSError(f"{self.draft} holds {found} rows instead of {self.n_rows}")
        self.fs.move(self.draft, self.path)
        return self.fs.get_file_info(self.path).size


def _write_shards(target: str, each: int):
    """Per shard: the files' sizes come first and are dealt to its groups, then the records stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(target)
        fs.create_dir(root, recursive=True)
        shard, ids, sizes, lines = None, [], [], []
        group_of: dict[int, tuple[int, np.ndarray]] | None = None
        groups: dict[int, _Group] = {}
        loads = [0] * each

        def deal() -> dict[int, tuple[int, np.ndarray]]:
            dealt = longest_first(sizes, each)
            for size, g in zip(sizes, dealt, strict=True):
                loads[g] += size
            return {f: (g, np.array(ls, np.int32)) for f, g, ls in zip(ids, dealt, lines, strict=True)}

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard")[0].as_py() if shard is None else shard
            listed = int(np.count_nonzero(batch.column("kind").to_numpy() == 0))
            if listed:
                head = batch.slice(0, listed)
                ids += head.column("file_id").to_pylist()
                sizes += head.column("n_bytes").to_pylist()
                lines += head.column("lines").to_pylist()
            if listed == batch.num_rows:
                continue
            if group_of is None:
                group_of = deal()
            rows = batch.slice(listed)
            files, numbers = rows.column("file_id").to_numpy(), rows.column("line_no").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
            places: dict[int, list[np.ndarray]] = {}
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (found := group_of.get(int(files[a]))) is not None:
                    places.setdefault(found[0], []).append(a + np.flatnonzero(np.isin(numbers[a:b], found[1])))
            stored = pa.Table.from_batches([rows.select(_STORED.names)]).cast(_STORED)
            chars = rows.column("size").to_numpy()
            for g, parts in places.items():
                at = np.concatenate(parts)
                if len(at):
                    if g not in groups:
                        groups[g] = _Group(fs, root, shard * each + g)
                    groups[g].add(stored.take(pa.array(at)), int(chars[at].sum()))
        done = [(shard, x.group_id, x.name, x.n_rows, loads[g], x.close()) for g, x in sorted(groups.items())]
        columns = list(zip(*done, strict=True)) if done else [()] * 6
        types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return run


def _publish(spark: SparkSession, target: str, manifest: dict) -> None:
    """Create the manifest; exactly one run can."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest.json")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()


def compact(spark: SparkSession, files: DataFrame, target: str, target_bytes: int = 64 << 20, groups_per_shard: int = 8) -> dict:
    """Consolidate ``files`` (file_id, participant, stream, content) below the folder ``target``.

    Writes at once and returns the published manifest: the run's folder, its groups, rows and
    checksum; ``manifest_files`` gives a row per output file. ``target_bytes`` counts the
    characters of the records' lines. Files and records delivered more than once, damaged lines
    and null contents leave each record exactly once; a null participant or stream is a value
    of its own. An input without records publishes an empty manifest. Extra columns are ignored.
    """
    pin(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest.json")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileExistsError(f"{target} already has a manifest")
    name = f"run-{uuid.uuid4().hex}"
    run = f"{target}/{name}"
    read_records(files).write.parquet(f"{run}/staged")
    records = spark.read.schema(RECORD_SCHEMA).parquet(f"{run}/staged")
    owned_lines(records).write.parquet(f"{run}/owned")
    owned = spark.read.schema("file_id long, n_bytes long, n_rows long, checksum long, lines array<int>").parquet(f"{run}/owned")
    total, n_rows, checksum = owned.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_bytes", "n_rows", "checksum")]).first()
    groups = max(1, -(-total // target_bytes))
    shards = -(-groups // groups_per_shard)
    each = -(-groups // shards)
    shard = F.pmod(F.xxhash64("file_id"), F.lit(shards)).cast("int").alias("shard")
    sizes = owned.select(shard, F.lit(0).alias("kind"), "file_id", "n_bytes", "lines")
    rows = records.select(shard, F.lit(1).alias("kind"), *records.columns)
    both = sizes.unionByName(rows, allowMissingColumns=True).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "file_id")
    both.mapInArrow(_write_shards(f"{run}/data", each), MANIFEST).write.parquet(f"{run}/manifest")
    written = manifest_of(spark, run).agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    stored = spark.read.schema(STORED).parquet(f"{run}/data").agg(F.count(F.lit(1)), _checksum()).first() if n_rows else (0, 0)
    if written[1] != n_rows or tuple(stored) != (n_rows, checksum):
        raise OSError("the written files don't hold the records exactly once")
    manifest = {"run": name, "n_files": written[0], "n_rows": n_rows, "checksum": checksum, "groups": shards * each}
    _publish(spark, target, manifest)
    for scratch in ("staged", "owned"):
        remove_dir(spark, f"{run}/{scratch}")
    return manifest


def manifest_of(spark: SparkSession, run: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{run}/manifest")


def _run(spark: SparkSession, target: str) -> tuple[str, int]:
    found = json.loads(spark.read.text(f"{target}/manifest.json", wholetext=True).first()[0])
    return f"{target}/{found['run']}", found["n_rows"]


def manifest_files(spark: SparkSession, target: str) -> DataFrame:
    """``shard, group_id, file_name, n_rows, load, n_bytes`` of each output file of the published run."""
    return manifest_of(spark, _run(spark, target)[0])


def published(spark: SparkSession, target: str) -> DataFrame:
    """The records of the run that the manifest of ``target`` names."""
    run, n_rows = _run(spark, target)
    return spark.read.schema(STORED).parquet(f"{run}/data") if n_rows else spark.createDataFrame([], STORED)
