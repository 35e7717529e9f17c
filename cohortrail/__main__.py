"""Command line: python -m cohortrail SRC OUT [--skip-etl | --refresh] [--approx] [--multiline TABLE...]."""

from __future__ import annotations

import argparse
import logging

from cohortrail.plans.run_all import run_all
from cohortrail.session import build_session
from cohortrail.study import Study


def main() -> None:
    parser = argparse.ArgumentParser(prog="cohortrail", description=__doc__)
    parser.add_argument("src", help="folder of the seven CSV files")
    parser.add_argument("out", help="folder for tables and results")
    parser.add_argument("--skip-etl", action="store_true", help="reuse the loaded tables in OUT")
    parser.add_argument(
        "--refresh", action="store_true",
        help="take in further parts of the encounters' folder, computing only their patients again",
    )
    parser.add_argument(
        "--multiline", nargs="*", default=[], metavar="TABLE",
        help="tables whose quoted fields may hold line breaks",
    )
    parser.add_argument(
        "--partitions",
        help="partitions of an exchange before coalescing: bytes of encounters over 64 MB or more",
    )
    parser.add_argument(
        "--buckets", type=int, help="files of a table stored by patient: its bytes over 128 MB"
    )
    parser.add_argument(
        "--approx", action="store_true", help="quantiles from a sketch of fixed size, not exact ones"
    )
    parser.add_argument("--master", help="Spark master, if spark-submit does not give one")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(message)s")
    conf = {}
    if args.partitions:
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = args.partitions
    spark = build_session(master=args.master, **conf)
    study = Study(approx=args.approx)
    run_all(
        spark, args.src, args.out, args.skip_etl, study, args.multiline, args.buckets, args.refresh
    )
    spark.stop()


if __name__ == "__main__":
    main()
