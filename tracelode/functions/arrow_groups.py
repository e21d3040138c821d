"""Streams of sorted Arrow batches cut into runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, columns) of each run of equal keys; the first ``keys`` columns are the key.

    One run is held at a time, however the batches are cut; empty batches are passed over.
    """
    key: tuple | None = None
    parts: list[list[np.ndarray]] = []

    def whole() -> list[np.ndarray]:
        return [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*parts, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        heads = [batch.column(i).dictionary_encode() for i in range(keys)]
        codes = [h.indices.to_numpy() for h in heads]
        cuts = np.flatnonzero(np.any([np.r_[True, c[1:] != c[:-1]] for c in codes], axis=0)).tolist() + [batch.num_rows]
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys, batch.num_columns)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            new = tuple(h.dictionary[int(c[a])].as_py() for h, c in zip(heads, codes, strict=True))
            if key is not None and new != key:
                yield key, whole()
                parts = []
            key = new
            parts.append([c[a:b] for c in columns])
    if key is not None:
        yield key, whole()


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sorted_groups(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of each key together and in order, for a step whose cost is its own work, not its bytes.

    The number of partitions is stated, so that small inputs aren't put into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def widened(scan: DataFrame, least_tasks: int | None) -> DataFrame:
    """A scan dealt out over ``least_tasks`` tasks where its files give fewer splits; None leaves every scan as it is."""
    return scan if least_tasks is None or scan.rdd.getNumPartitions() >= least_tasks else scan.repartition(least_tasks)
