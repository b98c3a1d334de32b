"""Run every query beside its SQL and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from . import oracle, registry


def session(cpus: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("logfathom")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(frame) -> list[tuple]:
    return sorted(tuple(map(repr, row)) for row in frame)


def compare(spark: SparkSession, sf_dir: str, name: str) -> tuple[bool, str]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    began = time.time()
    df = registry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = rows_of(df.select(*names).collect())
    took = time.time() - began
    sql = oracle.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.2f}s"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != names:
        return False, f"columns {names} against {sorted(columns)}"
    order = [columns.index(n) for n in names]
    want = rows_of(tuple(row[i] for i in order) for row in result.fetchall())
    if got == want:
        return True, f"{len(got)} rows, {took:.2f}s"
    extra, missing = set(got) - set(want), set(want) - set(got)
    return False, (f"{len(got)} against {len(want)} rows, {len(extra)} extra, {len(missing)} missing\n"
                   f"   names   {names}\n   extra   {sorted(extra)[:2]}\n   missing {sorted(missing)[:2]}")


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(registry.queries())
    spark = session()
    bad = 0
    for name in names:
        try:
            ok, text = compare(spark, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, text, flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
