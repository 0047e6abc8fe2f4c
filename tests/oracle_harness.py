"""Compare a Spark DataFrame with a DuckDB oracle query, the way the driver
does: row count, column names, and an order-insensitive value comparison.

Usable from pytest and from the command line:
    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duckdb_con(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=_key)
    return cols, out


def spark_type_name(t) -> str:
    """Spark type -> the DuckDB type name it corresponds to."""
    from pyspark.sql import types as T

    simple = {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
              T.DateType: "DATE", T.BooleanType: "BOOLEAN", T.ShortType: "SMALLINT", T.FloatType: "FLOAT"}
    for k, v in simple.items():
        if isinstance(t, k):
            return v
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return str(t)


def compare(spark_df, con, sql, max_diffs=5):
    t0 = time.time()
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = [c for c in rel.columns]
    s_types = {f.name: spark_type_name(f.dataType) for f in spark_df.schema.fields}
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    t2 = time.time()
    sc, sr = normalise(s_cols, s_rows)
    dc, dr = normalise(d_cols, d_rows)
    problems = []
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duckdb={dc}")
    else:
        bad_types = {c: (s_types[c], d_types[c]) for c in sc if s_types[c] != d_types[c]}
        if bad_types:
            problems.append(f"types differ: {bad_types}")
    if len(sr) != len(dr):
        problems.append(f"row count differs: spark={len(sr)} duckdb={len(dr)}")
    if not problems:
        diffs = [(a, b) for a, b in zip(sr, dr) if a != b]
        if diffs:
            problems.append(f"{len(diffs)} rows differ, e.g. {diffs[:max_diffs]}")
    return {
        "ok": not problems, "problems": problems, "rows": len(sr),
        "spark_sec": round(t1 - t0, 2), "duckdb_sec": round(t2 - t1, 2),
    }


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from tallyframe.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duckdb_con(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(f"{name:36s} NO-ORACLE rows={n}")
            continue
        try:
            res = compare(qs[name](spark, sf_dir), con, sqls[name])
        except Exception as e:  # noqa: BLE001
            res = {"ok": False, "problems": [f"{type(e).__name__}: {str(e)[:400]}"]}
        bad += not res["ok"]
        status = "OK " if res["ok"] else "BAD"
        print(f"{name:36s} {status} rows={res.get('rows')} spark={res.get('spark_sec')}s "
              f"duck={res.get('duckdb_sec')}s {'; '.join(res['problems'])}", flush=True)
    print(f"{bad} failing of {len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
