"""Run registered queries beside their SQL: python tests/compare.py sf0.01 [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from furrow.fixtures import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), repr(v)) for v in row)


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def compare(spark, con, sf_dir: str, function, sql: str | None) -> tuple[bool, str]:
    df = function(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    if sql is None:
        return True, f"rows={len(mine)}"
    names = [d[0] for d in con.execute(sql).description]
    if sorted(names) != columns:
        return False, f"columns {columns} / {sorted(names)}"
    cells = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    theirs = sorted((tuple(_plain(v) for v in r) for r in cells), key=_key)
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return False, f"first difference {dict(zip(columns, a))} / {dict(zip(columns, b))}"
    return True, f"rows={len(mine)}"


def main() -> int:
    from furrow.session import build_session
    from verification import ORACLES, QUERIES

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                               "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, function in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.perf_counter()
        try:
            good, note = compare(spark, con, sf_dir, function, ORACLES.get(name))
        except Exception as e:
            good, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not good
        print(f"{'ok  ' if good else 'BAD '} {name} {time.perf_counter() - start:.1f}s "
              f"{'' if name in ORACLES else '(rows only) '}{note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
