"""Command line: python -m tracelode {communication,walking,mobility,surveys} STUDY OUT [options]."""

from __future__ import annotations

import argparse

from tracelode import pipelines
from tracelode.functions.timebins import Frequency
from tracelode.session import build_session


def main(argv: list[str] | None = None, spark=None) -> None:
    parser = argparse.ArgumentParser(prog="tracelode")
    parser.add_argument("analysis", choices=["communication", "walking", "mobility", "surveys"])
    parser.add_argument("study")
    parser.add_argument("out")
    parser.add_argument("--zone", default="UTC")
    parser.add_argument("--frequency", default="daily", choices=[f.name.lower() for f in Frequency])
    parser.add_argument("--config")
    parser.add_argument("--interventions")
    parser.add_argument("--start", help="first date of surveys")
    parser.add_argument("--end", help="last date of surveys")
    asked = parser.parse_args(argv)
    spark = spark or build_session("tracelode")
    frequency = Frequency[asked.frequency.upper()]
    each = (Frequency.HOURLY, Frequency.DAILY) if frequency == Frequency.HOURLY_AND_DAILY else (frequency,)
    if asked.analysis == "surveys":
        pipelines.surveys(spark, asked.study, asked.out, asked.zone, asked.config, asked.interventions, asked.start, asked.end)
    elif asked.analysis == "communication":
        pipelines.communication(spark, asked.study, asked.out, frequency, asked.zone)
    else:
        getattr(pipelines, asked.analysis)(spark, asked.study, asked.out, each, asked.zone)


if __name__ == "__main__":
    main()
