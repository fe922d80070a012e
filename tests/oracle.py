"""Run registered queries and their checking SQL side by side and compare all rows.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v: object) -> object:
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, dt.date) else v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {
    "bigint": "int", "int": "int", "tinyint": "int", "smallint": "int", "double": "float", "float": "float", "string": "str",
    "boolean": "bool", "date": "date", "timestamp_ntz": "ts", "timestamp": "ts",
    "BIGINT": "int", "INTEGER": "int", "TINYINT": "int", "SMALLINT": "int", "HUGEINT": "huge", "DOUBLE": "float", "FLOAT": "float",
    "VARCHAR": "str", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts",
}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or nothing."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    got = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine, theirs = rows_of(df.columns, got), rows_of(names, expected)
    if len(mine) != len(theirs):
        return f"row count {len(mine)} != {len(theirs)}; {mine[:2]} / {theirs[:2]}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, e.g. {wrong[0][0]} != {wrong[0][1]}"
    kinds = {c: (KINDS.get(t, t), KINDS.get(types[c], types[c])) for c, t in df.dtypes}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    return f"types {odd}" if odd else None


def main() -> None:
    from tabwright import build_session
    from tabwright.plans.suite import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = build_session("oracle", "8")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = compare(df, con, ORACLES[name]) if name in ORACLES else None
            note = "ok" if name in ORACLES else f"rows only: {df.count()}"
        except Exception as err:
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
    print(f"{len(chosen)} queries, {bad} problems")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
