"""Run registered queries on a table folder and compare each with its SQL in DuckDB.

    python tools/check_oracles.py [name-prefix ...]   (folder from CHECK_SF_DIR)
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1e9 else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def spark_kind(kind: str) -> str:
    for prefix, label in (
        ("array", "list"), ("decimal", "decimal"), ("timestamp", "time"), ("date", "date"),
        ("string", "text"), ("boolean", "bool"), ("double", "float"), ("float", "float"),
    ):
        if kind.startswith(prefix):
            return label
    return "int" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def duck_kind(kind: str) -> str:
    kind = str(kind)
    if kind.endswith("[]"):
        return "list"
    for prefix, label in (
        ("DECIMAL", "decimal"), ("TIMESTAMP", "time"), ("DATE", "date"), ("VARCHAR", "text"),
        ("BOOLEAN", "bool"), ("DOUBLE", "float"), ("FLOAT", "float"),
    ):
        if kind.startswith(prefix):
            return label
    return "int" if kind in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT") else kind


def main(prefixes: list[str]) -> int:
    import duckdb

    from postmill.session import build_session
    from queries import ORACLES, QUERIES

    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            df = fn(spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: spark: {str(exc)[:1500]}")
            continue
        took = time.time() - started
        if name not in ORACLES:
            print(f"rows  {name}: {sum(got.values())} rows, {took:.1f}s")
            continue
        try:
            cur = con.execute(ORACLES[name])
            columns = [d[0] for d in cur.description]
            kinds = {d[0]: duck_kind(d[1]) for d in cur.description}
            want = rows_of(columns, cur.fetchall())
        except Exception as exc:
            bad += 1
            print(f"FAIL  {name}: oracle: {str(exc)[:800]}")
            continue
        if sorted(df.columns) != sorted(columns):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(df.columns)} <> {sorted(columns)}")
        elif got != want:
            bad += 1
            print(f"FAIL  {name}: {sum(got.values())} rows <> {sum(want.values())}")
            for label, diff in (("spark", got - want), ("sql", want - got)):
                for row in list(diff)[:3]:
                    print(f"      {label}: {str(row)[:400]}")
        else:
            note = "" if got else "  (EMPTY)"
            for column, kind in df.dtypes:
                if spark_kind(kind) != kinds[column]:
                    note += f"  [{column}: {kind} <> {kinds[column]}]"
            print(f"ok    {name}: {sum(got.values())} rows, {took:.1f}s{note}")
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
