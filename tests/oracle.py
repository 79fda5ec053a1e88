"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/oracle.py [name-part ...]
"""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def canon(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return f"D{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a text that says what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return None if a else "EMPTY"
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} vs {len(b)} cols={sorted(cols)}\n   spark {only_a}\n   duck  {only_b}"


if __name__ == "__main__":
    from conftest import SF, make_session

    import __spark_entry__ as entry
    spark = make_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(SF)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if sys.argv[1:] and not any(part in name for part in sys.argv[1:]):
            continue
        t = time.time()
        try:
            if name in oracle:
                why = compare(spark, con, SF, fn, oracle[name])
            else:
                n = fn(spark, SF).count()
                why = None if n else "EMPTY"
        except Exception as e:  # report and go on with the other queries
            why = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'BAD '} {name} {time.time() - t:.1f}s"
              f"{'' if name in oracle else ' (rows only)'} {why or ''}", flush=True)
    print("bad:", bad)
