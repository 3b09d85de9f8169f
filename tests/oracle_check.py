"""Runs queries beside their SQL: python tests/oracle_check.py [SF_DIR] [NAME...]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings channels videos caption_docs caption_cues chapters info_json video_drops lang_samples graded_samples pack_targets".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect(d):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(d, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, d, name, query, sql):
    df = query(spark, d)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = table_of(rel.columns, rel.fetchall())
    return got, want


def main(args):
    import __spark_entry__ as entry
    from tests.conftest import make_session

    d = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(d)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in args or queries:
        t = time.time()
        try:
            if name not in sql:
                n = queries[name](spark, d).count()
                print(f"rows {name} {n} {time.time() - t:.1f}s", flush=True)
                continue
            got, want = compare(spark, con, d, name, queries[name], sql[name])
            ok = got == want
            print(f"{'ok  ' if ok else 'DIFF'} {name} {len(got[1])} {len(want[1])} {time.time() - t:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   ", got[0], want[0])
                g, w = set(got[1]), set(want[1])
                print("    only here:", sorted(g - w)[:3], "\n    only SQL: ", sorted(w - g)[:3])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print("FAIL", name, str(e)[:600], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
