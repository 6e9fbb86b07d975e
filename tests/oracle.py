"""Compares a query with its SQL over the same tables, column by column, in any order."""

import math
from pathlib import Path

import duckdb


def rows_of(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"
        if isinstance(x, bool) or x is None:
            return str(x)
        return f"{float(x):.6g}" if isinstance(x, int) and abs(x) < 2**20 else str(x)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(name, spark, sf_dir):
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    want = canon(*rows_of(e.oracle_sql()[name], sf_dir))
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    assert got[1] == want[1], [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
    return len(got[1])
