"""Compare every query with its SQL definition: ``python -m verification.check [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from dugout.session import local_session
from dugout.sources.shared import remove_written
from verification.queries import ORACLES, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def _canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0  # no negative zero
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    mine = sorted_rows(df.columns, df.collect())
    if name not in ORACLES:
        return bool(mine), f"{len(mine)} rows, no SQL"
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    theirs = sorted_rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or list(map(type, a)) != list(map(type, b)):
            return False, f"{sorted(names)}: {a} != {b}"
    return True, f"{len(mine)} rows"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, failures = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # report every query, also the ones that do not run
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s  {note}", flush=True)
    remove_written(spark)
    print(f"{len(names) - failures}/{len(names)} passed")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
