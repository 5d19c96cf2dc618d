"""Run registered queries beside their SQL on the given tables and compare.

usage: python tools/check.py [sf0.01] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from barloom.registry import load_all  # noqa: E402
from barloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def norm(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or str(v) in ("NaT", "<NA>", "nan", "None"):
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            v = float(v)
            return f"{v:.6f}".replace("-0.000000", "0.000000")
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(norm(x) for x in v) + "]"
        if hasattr(v, "isoformat"):
            return str(v)[:19].replace(" 00:00:00", "")
        return str(v)

    return sorted(tuple(norm(v) for v in r) for r in frame.itertuples(index=False)), list(frame.columns)


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    folder = f"/root/testdata/{sf}"
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name, c in load_all().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            got = c.query(spark, folder).toPandas()
            t1 = time.time()
            if c.sql is None:
                print(f"rows  {name:38s} {len(got):8d} {t1 - t0:6.2f}s", flush=True)
                if not len(got):
                    bad.append(name)
                continue
            want = con.sql(c.sql).df()
            t2 = time.time()
            a, ca = rows_of(got)
            b, cb = rows_of(want)
            ok = a == b and ca == cb
            print(f"{'ok   ' if ok else 'DIFF '} {name:38s} {len(a):8d} {t1 - t0:6.2f}s duck {t2 - t1:5.2f}s"
                  f"{'' if len(a) else '  EMPTY'}", flush=True)
            if not ok:
                bad.append(name)
                if ca != cb:
                    print("   columns", ca, cb)
                elif len(a) != len(b):
                    print("   rows", len(a), len(b))
                else:
                    miss = [(x, y) for x, y in zip(a, b) if x != y]
                    print(f"   {len(miss)} differ", ca, miss[:3])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
