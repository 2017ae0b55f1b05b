"""Compare registered queries with their SQL in DuckDB: python tests/oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, bool) or isinstance(v, (int, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)[:26]


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    sc, sr = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = _rows([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, columns {sc}; first:\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return ""


def main() -> None:
    from skuflow.plans.registry import ORACLE, QUERIES
    from skuflow.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(8), connect(sf_dir), []
    for name in names:
        t = time.time()
        try:
            if name in ORACLE:
                msg = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
            else:
                msg = "" if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if not msg else 'FAIL'} {name} {time.time() - t:.1f}s {'' if name in ORACLE else '(no SQL)'} {msg}", flush=True)
        if msg:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
