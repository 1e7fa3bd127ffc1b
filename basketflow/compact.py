"""Pack the closed days of all stored tables: ``python -m basketflow.compact --base-path /retail``."""

import argparse
from datetime import date

from pyspark.sql import SparkSession

from basketflow.plans.session import build_session
from basketflow.schema import TABLE_SCHEMAS
from basketflow.sources import stored_days
from basketflow.streaming import compact


def compact_tables(spark: SparkSession, base_path: str, target_mb: int = 128) -> dict[str, list[date]]:
    """The days packed now, by table. Flat tables and tables not yet written are passed over."""
    base = base_path.rstrip("/")
    return {
        table: compact(spark, f"{base}/{table}", table, target_mb << 20)
        for table in TABLE_SCHEMAS
        if stored_days(spark, f"{base}/{table}")
    }


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="basketflow.compact", description=__doc__)
    parser.add_argument("--base-path", required=True)
    parser.add_argument("--target-mb", type=int, default=128)
    chosen = parser.parse_args(argv)
    spark = build_session("basketflow-compact")
    try:
        for table, days in compact_tables(spark, chosen.base_path, chosen.target_mb).items():
            print(f"{table}: {len(days)} days" + (f", {days[0]} to {days[-1]}" if days else ""))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
