"""Compare registered queries with their SQL: ``python check.py [sf] [name …]``."""

from __future__ import annotations

import sys
import time

import duckdb

from quadhap.plans import REGISTRY
from quadhap.plans.registry import TABLES
from quadhap.session import local_session


def canonical(rows: list[tuple]) -> list[str]:
    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted("|".join(cell(v) for v in r) for r in rows)


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8, 8, "check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in args or list(REGISTRY):
        entry = REGISTRY[name]
        t0 = time.time()
        try:
            df = entry.run(spark, folder)
            cols = sorted(df.columns)
            got = [tuple(r) for r in df.select(*cols).collect()]
            t1 = time.time()
            note = "rows only"
            if entry.sql is not None:
                cur = con.execute(entry.sql)
                have = [d[0] for d in cur.description]
                if sorted(have) != cols:
                    note = f"COLUMNS {sorted(have)} vs {cols}"
                    bad += 1
                else:
                    order = [have.index(c) for c in cols]
                    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
                    g, w = canonical(got), canonical(want)
                    note = "ok" if g == w else "MISMATCH"
                    if g != w:
                        bad += 1
                        print("  cols ", cols)
                        print("  spark", sorted(set(g) - set(w))[:3], len(set(g) - set(w)))
                        print("  sql  ", sorted(set(w) - set(g))[:3], len(set(w) - set(g)))
            print(f"{name:28s} {note:10s} rows={len(got):7d} spark={t1 - t0:6.2f}s sql={time.time() - t1:6.2f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} ERROR {str(e)[:900]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
