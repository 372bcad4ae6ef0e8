"""Run named queries next to their SQL and compare the rows: python tools/check.py [--sf DIR] [name prefix ...]"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from pagemill import catalog  # noqa: E402
from pagemill.session import local_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, query, sql):
    started = time.time()
    df = query(spark, sf_dir)
    cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return True, f"{name}: rows only ({len(rows)}) {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    ocols, orows = canonical(names, cur.fetchall())
    if cols != ocols:
        return False, f"{name}: columns {cols} != {ocols}"
    if rows != orows:
        a, b = [r for r in rows if r not in set(orows)][:2], [r for r in orows if r not in set(rows)][:2]
        return False, f"{name}: {len(rows)} vs {len(orows)} rows {took:.1f}s\n   ours   {str(a)[:900]}\n   oracle {str(b)[:900]}"
    return True, f"{name}: ok ({len(rows)} rows) {took:.1f}s"


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = catalog.queries(), catalog.oracles()
    bad = 0
    for name in sorted(queries):
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            ok, text = compare(spark, con, name, sf_dir, queries[name], oracles.get(name))
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{name}: {type(e).__name__} {str(e)[:700]}"
        bad += not ok
        print(("" if ok else "FAIL ") + text, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
