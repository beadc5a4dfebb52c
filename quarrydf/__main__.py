"""``python -m quarrydf read|read-column|stats|validate PATH [COLUMN] [--rows N]``: look at a table folder from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quarrydf.plans.query import to_csv
from quarrydf.sources import interchange, store


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all is well, 1 if the table cannot be read."""
    parser = argparse.ArgumentParser(prog="quarrydf")
    parser.add_argument("command", choices=["read", "read-column", "stats", "validate"])
    parser.add_argument("path")
    parser.add_argument("column", nargs="?")
    parser.add_argument("--rows", type=int, default=20)
    asked = parser.parse_args(arguments)
    if asked.command == "read-column" and not asked.column:
        parser.error("read-column needs a column")
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if asked.command == "stats":
            print(json.dumps(interchange.file_stats(spark, asked.path)))
        elif asked.command == "validate":
            # every cell of every column is decoded
            store.read(spark, asked.path).write.format("noop").mode("overwrite").save()
            print("valid")
        else:
            print(to_csv(store.read(spark, asked.path, columns=[asked.column] if asked.column else []), asked.rows), end="")
    except Exception as e:  # noqa: BLE001  reported, not hidden
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
