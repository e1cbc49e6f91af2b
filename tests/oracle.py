"""Compare every registered query with its DuckDB twin.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

from boxweave.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(pdf: pd.DataFrame) -> list[str]:
    cols = sorted(pdf.columns)

    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        return repr(v.item()) if hasattr(v, "item") else repr(v)

    return sorted("|".join(text(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, otherwise what differs."""
    got, want = fn(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(want) == 0:
        return "no rows to compare"
    kinds = {c: (got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype != want[c].dtype}
    kinds = {c: k for c, k in kinds.items() if not all(str(x) in ("object", "str", "string") for x in k)}
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows {kinds}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]} {kinds}"
    return f"types {kinds}" if kinds else None


def main() -> int:
    import __spark_entry__ as entry
    from boxweave.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session("8"), connect(sf_dir)
    failed = 0
    for name in names:
        began = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                problem = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None and not problem.startswith("rows only")
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} problems")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
