"""Run registered queries in Spark and their SQL twins in DuckDB and compare."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(t) -> str:
    import pyarrow as pa

    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    return str(t)


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def _clean(x):
    if isinstance(x, float):
        return float("nan") if math.isnan(x) else x
    return x


def compare(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    left = df.toArrow()
    right = con.execute(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return f"columns {sorted(left.column_names)} != {sorted(right.column_names)}"
    cols = sorted(left.column_names)
    kinds = [(c, _kind(left.schema.field(c).type), _kind(right.schema.field(c).type)) for c in cols]
    wrong = [k for k in kinds if k[1] != k[2]]
    if wrong:
        return f"types {wrong}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} != {right.num_rows}"
    if left.num_rows == 0:
        return "both empty"
    a = sorted(zip(*[map(_clean, left[c].to_pylist()) for c in cols]), key=_key)
    b = sorted(zip(*[map(_clean, right[c].to_pylist()) for c in cols]), key=_key)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ in {cols}, first: {bad[:3]}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from fieldloom.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(queries[name](spark, sf_dir), con, oracles[name])
            else:
                n = queries[name](spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            text = "".join(traceback.format_exception_only(e))
            tb = traceback.extract_tb(e.__traceback__)
            where = [f"{f.filename.rsplit('/', 1)[-1]}:{f.lineno}" for f in tb if "repo" in f.filename][-2:]
            problem = f"{where} {text[:700]}"
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{note} {time.time() - start:.1f}s", flush=True)
        if problem:
            failed.append(name)
            print("     ", problem, flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
