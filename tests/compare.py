"""Runs registered queries and their SQL side by side. Usage: python tests/compare.py sf [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark, con, sf_dir, name, queries, oracles):
    """None when equal, else a text."""
    df = queries[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return None if got[1] else "no rows"
    rel = con.execute(oracles[name])
    want = normal([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} vs {len(want[1])}; spark only {list(a - b)[:2]}; sql only {list(b - a)[:2]}"
    return None if got[1] else "equal but empty"


def main():
    import __spark_entry__ as entry
    from foliospark.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", partitions=8, scratch=tempfile.mkdtemp(prefix="compare-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, name, queries, oracles)
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:900]}"
        bad += found is not None
        kind = "S" if name in oracles else "R"
        print(f"{'ok ' if found is None else 'BAD'} {kind} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
