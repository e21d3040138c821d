from __future__ import annotations

import json

import pandas as pd
import pytest

from tracelode.operators.compaction import compact, longest_first, manifest_files, parse_file, published
from tracelode.session import fresh_dir

HEAD = "timestamp,UTC time,x\n"


@pytest.mark.parametrize(
    ("content", "stamps"),
    [
        (None, []),
        ("", []),
        (HEAD, []),
        (HEAD + "5,1970-01-01T00:00:00.005,1\n\n6,,2", [5, 6]),
        ("﻿" + HEAD.replace("\n", "\r\n") + "5,x,1\r\n", [5]),
        ('"UTC time","x","timestamp"\n"1970-01-01T00:00:01.5","a,b",""\n', [1500]),
        (HEAD + "5,u,1\n" + HEAD + "7,u\n8,u,1,1\n9,u,1", [5, 9]),
        ("x;timestamp;UTC time\n1;4;\n", [4]),
        (HEAD + "abc,u,1\n,not a time,2\n", []),
        ("no header\n5,u,1\n", []),
    ],
)
def test_records_of_a_file(content, stamps):
    assert [r[1] for r in parse_file(content)] == stamps


def test_longest_first_is_balanced():
    sizes = pd.Series([9, 1, 1, 1, 7, 3, 5, 5])
    loads = pd.Series(longest_first(sizes, 4)).groupby(longest_first(sizes, 4)).size()
    by = sizes.groupby(longest_first(sizes, 4)).sum()
    assert len(loads) == 4 and by.max() <= 9


def test_every_record_stands_once_and_readers_follow_the_manifest(spark):
    files = [(i, "p" if i % 3 else "q", "gps", HEAD + "".join(f"{1000 * i + k},u,{k}\n" for k in range(20))) for i in range(60)]
    files += [(100 + i, *f[1:]) for i, f in enumerate(files[:10])] + [(200, "p", None, None), (201, None, "gps", HEAD + "1,u,1")]
    df = spark.createDataFrame(files, "file_id long, participant string, stream string, content string")
    target = fresh_dir(spark, "t")
    manifest = compact(spark, df, target, target_bytes=1000, groups_per_shard=3)
    rows = published(spark, target)
    assert manifest["n_rows"] == rows.count() == rows.select("participant", "stream", "record_ms").distinct().count() == 60 * 20 + 1
    parts = manifest_files(spark, target).toPandas()
    assert 1 < len(parts) < 40 and len(parts) == manifest["n_files"] and parts.n_rows.sum() == manifest["n_rows"]
    loads = parts.groupby("shard").load.agg(["max", "mean", "count"])
    assert loads["count"].max() > 1 and len(loads) > 1 and (loads["max"] <= 1.3 * loads["mean"]).all()
    assert json.loads(rows.where("record_ms = 3005").first().fields) == {"x": "5"}
    rows.limit(1).write.parquet(f"{target}/data/stray.parquet")
    assert published(spark, target).count() == manifest["n_rows"]
    with pytest.raises(Exception):  # noqa: B017 - the folder is taken
        compact(spark, df, target)


def test_no_records(spark):
    df = spark.createDataFrame([(1, "p", "s", "")], "file_id long, participant string, stream string, content string")
    target = fresh_dir(spark, "t")
    assert compact(spark, df, target)["n_rows"] == 0 and published(spark, target).count() == 0
