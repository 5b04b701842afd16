"""Runs every registered query that has SQL against DuckDB: python tests/oracle.py [sf_dir] [names]"""

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(pdf):
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        if hasattr(v, "date") and callable(v.date):
            return str(v.date())
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v.item() if hasattr(v, "item") else str(v) if type(v).__name__ == "date" else v

    cols = sorted(pdf.columns)
    return sorted((tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        name = t.split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns), (sorted(a.columns), sorted(b.columns))
    x, y = rows_of(a), rows_of(b)
    assert len(x) == len(y), (len(x), len(y))
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    assert not bad, (len(bad), bad[:3])
    return len(x)


if __name__ == "__main__":
    from tidepanel.plans import catalog
    from tidepanel.session import session

    spark = session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    q, o = catalog.queries(), catalog.oracle_sql()
    for name in sys.argv[2:] or q:
        try:
            print(name, compare(spark, q[name], o[name], d) if name in o else f"rows only {q[name](spark, d).count()}", flush=True)
        except Exception as e:  # noqa: BLE001
            print("FAIL", name, str(e)[:500], flush=True)
