"""Run queries beside their SQL: ``python tests/run_oracle.py SF_DIR [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, name: str, query, sql: str | None, sf_dir: str) -> str:
    began = time.time()
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    took = time.time() - began
    if sql is None:
        return f"rows-only {len(mine)} {took:.1f}s"
    got = con.execute(sql)
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    if sorted(df.columns) != sorted(d[0] for d in got.description):
        return f"COLUMNS {sorted(df.columns)} {sorted(d[0] for d in got.description)}"
    if mine == theirs:
        return f"ok {len(mine)} {took:.1f}s"
    odd = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:2]
    return f"DIFF {len(mine)} {len(theirs)} {odd}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con, bad = session(), duck(sf_dir), 0
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        try:
            said = compare(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001  every query gets its line
            said = f"ERROR {str(error)[:1500]}"
        bad += not said.startswith(("ok", "rows-only"))
        print(name, said, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
