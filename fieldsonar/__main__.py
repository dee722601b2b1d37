"""The two runs from the command line.

    python -m fieldsonar detect ROOT --detector module:function --out DIR [--species FILE]
    python -m fieldsonar localise CSV ... --out DIR [--calibrate]
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from .plans import localise
from .settings import FIELD_TIMEZONE
from .sources import sinks


def _detector(spark: SparkSession, name: str):
    """The function; a module that is a file by itself goes to the executors."""
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    if "." not in module and not hasattr(found, "__path__") and found.__file__:
        spark.sparkContext.addPyFile(found.__file__)
    return getattr(found, function)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fieldsonar", description="Detections from recorder folders, and calls located from detections.")
    runs = parser.add_subparsers(dest="run", required=True)
    detect = runs.add_parser("detect", help="recordings to detections, as CSV")
    detect.add_argument("root")
    detect.add_argument("--detector", required=True, help="module:function that finds calls in a channel")
    detect.add_argument("--species", help="file with the names that the detector may report")
    detect.add_argument("--out", required=True)
    locate = runs.add_parser("localise", help="detections to sites, events, solutions, diagnostics and a map")
    locate.add_argument("paths", nargs="+")
    locate.add_argument("--out", required=True)
    locate.add_argument("--calibrate", action="store_true", help="correct clocks by the busiest site")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("fieldsonar").getOrCreate()
    if given.run == "detect":
        found = localise.detect_calls(spark, given.root, _detector(spark, given.detector), given.species)
        print("written" if sinks.write_csv(found, given.out, skip_empty=True) else "no calls were found; nothing is written")
        return
    spark.conf.set("spark.sql.session.timeZone", FIELD_TIMEZONE)
    tables = localise.localise(spark, given.paths, given.out, given.calibrate)
    for r in tables["summary"].collect():
        print(f"{r.measure}: {'-' if r.value is None else f'{r.value:g}'}")


if __name__ == "__main__":
    main()
