"""Writers of summaries and states, and small documents."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)


def write_by_key(df: DataFrame, folder: str, key: str = "participant") -> None:
    """One CSV file per value of ``key`` below ``folder``, the key only in the path; missing text stays empty."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).option("header", "true").option("nullValue", "").csv(folder)


def write_summaries(summaries: dict[str, DataFrame], folder: str, key: str = "participant") -> None:
    """``write_by_key`` for each frequency name below one folder."""
    for name, df in summaries.items():
        write_by_key(df, f"{folder.rstrip('/')}/{name}", key)


def write_state(df: DataFrame, folder: str) -> None:
    """Model state or trajectories as Parquet."""
    df.write.mode("overwrite").parquet(folder)


def append_rows(df: DataFrame, folder: str, missing: str = "") -> None:
    """Add rows to a CSV table with a header; missing text is written as ``missing``."""
    df.write.mode("append").option("header", "true").option("nullValue", missing).csv(folder)


def write_hourly(fixes: DataFrame, folder: str, at_s: str = "t") -> None:
    """One CSV folder per participant and UTC hour, named by the hour as uploads are."""
    hour = F.date_format(F.timestamp_seconds(F.floor(F.col(at_s) / 3600) * 3600), "yyyy-MM-dd HH_mm_ss")
    rows = fixes.withColumn("hour", hour)
    rows.repartition("participant", "hour").sortWithinPartitions("participant", "hour", at_s).write.mode("overwrite").partitionBy("participant", "hour").option("header", "true").csv(folder)


def read_summaries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All tables that ``write_by_key`` put below a folder as one, the key from the path, with the file's name.

    ``schema`` names the columns and, last, the key.
    """
    return spark.read.schema(schema).option("header", "true").csv(folder).withColumn("file_name", F.element_at(F.split("_metadata.file_path", "/"), -1))


def read_json(path: str, ordered: bool = False) -> Any | None:
    """A JSON document, None with a logged reason where it can't be read; ``ordered`` gives objects as lists of pairs."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"), object_pairs_hook=list if ordered else None)
    except (OSError, ValueError) as err:
        logger.warning("can't read %s: %s", path, err)
        return None


def write_json(value: Any, path: str) -> bool:
    """Write a JSON document; False with a logged reason where that fails."""
    try:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(value, indent=1, ensure_ascii=False), encoding="utf-8")
        return True
    except (OSError, TypeError, ValueError) as err:
        logger.warning("can't write %s: %s", path, err)
        return False


def log_to_csv(path: str, level: int = logging.INFO) -> logging.Handler:
    """Log the package's records to a CSV file of time, level, module and message; gives the handler for removal."""
    handler = logging.FileHandler(path)
    if Path(path).stat().st_size == 0:
        handler.stream.write("time,level,module,message\n")

    class _Row(logging.Formatter):
        def format(self, record: logging.LogRecord) -> str:
            text = record.getMessage().replace('"', '""')
            return f'{self.formatTime(record)},{record.levelname},{record.name},"{text}"'

    handler.setFormatter(_Row())
    package = logging.getLogger("tracelode")
    package.setLevel(level)
    package.addHandler(handler)
    return handler
