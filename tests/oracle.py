"""Run a registered query in Spark and its SQL in DuckDB on the same files and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else float(f"{value:.9g}"))
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo") is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


# Loose type classes: a difference between these would change a value hash.
KIND = {"bigint": "int", "int": "int", "integer": "int", "long": "int", "double": "float", "string": "text", "varchar": "text",
        "boolean": "bool", "timestamp": "time", "date": "date"}


def compare(df, con, sql: str) -> list[str]:
    problems = []
    got = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = [str(d[1]).lower() for d in cursor.description]
    want = cursor.fetchall()
    a_names, a = rows_of(df.columns, [tuple(r) for r in got])
    b_names, b = rows_of(names, want)
    if a_names != b_names:
        return [f"columns {sorted(set(a_names) ^ set(b_names))}"]
    spark_kinds = {f.name: KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    for name, kind in zip(names, kinds):
        if spark_kinds[name] != KIND.get(kind, kind):
            problems.append(f"type of {name}: {spark_kinds[name]} / {kind}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    if a != b:
        left, right = list((a - b).items()), list((b - a).items())
        key = lambda item: tuple(str(v) for v in item[0])
        left.sort(key=key), right.sort(key=key)
        problems.append(f"{len(left)} rows only in spark, {len(right)} only in sql: {left[:2]} / {right[:2]} {a_names}")
    if not got:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tallyfield.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("KEEP_PARTITIONS"):
        # Small data would be merged into one partition; this keeps the work split as on big data.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            problems = compare(df, con, oracles[name]) if name in oracles else ([] if df.collect() else ["no rows"])
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        bad += bool(problems)
        note = "" if name in oracles else " (rows only)"
        print(f"{'BAD ' if problems else 'ok  '}{name}{note} {time.time() - began:.1f}s", *problems, sep="\n     " if problems else "", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
