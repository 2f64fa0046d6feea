"""``python -m sievewright ingest FOLDER TABLES``: the files of a folder into the tables of an engine."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sievewright.functions.vectors import embedder_by_name
from sievewright.operators.extraction import extractors_by_name
from sievewright.plans.engine import Engine


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sievewright", description=__doc__)
    parser.add_argument("command", choices=["ingest"])
    parser.add_argument("folder")
    parser.add_argument("tables")
    parser.add_argument("--extractor", default="auto", choices=["auto", "spacy", "rules"])
    parser.add_argument("--reset", action="store_true", help="empty the tables first")
    given = parser.parse_args(args)
    engine = Engine(SparkSession.builder.getOrCreate(), given.tables, embedder=embedder_by_name("hashing"), extractors=extractors_by_name(given.extractor))
    if given.reset:
        engine.reset()
    engine.ingest_directory(given.folder).select("filename", "status", "error").orderBy("filename").show(1000, truncate=False)


if __name__ == "__main__":
    main()
