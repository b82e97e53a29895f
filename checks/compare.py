"""Run the registered queries next to their SQL: ``python -m checks.compare [dir] [names]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracles import ORACLES
from checks.queries import REGISTRY
from chunkwell.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both sides return the same columns and rows, else the first difference."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    wanted = [tuple(dict(zip(names, r))[n] for n in order) for r in found.fetchall()]
    actual = [tuple(r) for r in df.select(*order).collect()]
    if len(actual) != len(wanted):
        return f"{len(actual)} rows against {len(wanted)}"
    for a, w in zip(sorted(actual, key=_key), sorted(wanted, key=_key)):
        if a != w or [type(x) for x in a] != [type(x) for x in w]:
            return f"{a} against {w}"[:1500]
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    spark = configure(
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = 0
    for name, fn in REGISTRY.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
                outcome = problem or "same"
            else:
                problem, outcome = "", f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            problem = outcome = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{name:28} {time.time() - start:6.1f} s  {outcome}", flush=True)
    print(f"{failed} of {len(names or REGISTRY)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) > 0)
