"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.session import pin


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, read lazily with the pinned session settings."""
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")
