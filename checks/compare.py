"""Run queries and their oracles side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracles import oracles
from checks.queries import QUERIES, run

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both results hold the same columns, types and rows; else what differs."""
    names = sorted(df.columns)
    shown = con.execute(f"DESCRIBE {sql}").fetchall()
    types = {r[0]: r[1] for r in shown}
    if names != sorted(types):
        return f"columns {names} against {sorted(types)}"
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    wrong = {c: (kinds[c], types[c]) for c in names if kinds[c] != types[c]}
    if wrong:
        return f"types {wrong}"
    mine = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=_key)
    quoted = ", ".join(f'"{c}"' for c in names)
    theirs = sorted(con.execute(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if not all(map(_same, a, b)):
            return f"row {dict(zip(names, a, strict=True))} against {dict(zip(names, b, strict=True))}"
    return None


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    chosen = args[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wardlens-"))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, expected, bad = connect(sf_dir), oracles(), 0
    for name in chosen:
        begin = time.time()
        try:
            df = run(name, spark, sf_dir)
            if name in expected:
                found = differences(df, con, expected[name])
                result = "same" if found is None else f"DIFFERS: {found}"
            else:
                result = f"{len(df.collect())} rows, no oracle"
        except Exception as error:  # noqa: BLE001
            result = f"FAILED: {str(error)[:600]}"
        bad += result.startswith(("DIFFERS", "FAILED"))
        print(f"{name:28s} {time.time() - begin:6.2f}s {result}", flush=True)
    for name in expected.keys() - QUERIES.keys():
        bad += 1
        print(f"{name:28s} has an oracle but no query")
    print(f"{len(chosen)} queries, {bad} wrong")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
