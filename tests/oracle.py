"""python tests/oracle.py SF_DIR [PREFIX ...]: runs queries beside their SQL in DuckDB and says where they differ."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return round(float(x), 6) + 0.0
    return x


def compare(spark_df, relation):
    """None if equal, else what differs."""
    names, theirs = sorted(spark_df.columns), sorted(relation.columns)
    if names != theirs:
        return f"columns {names} and {theirs}"
    key = lambda row: [(v is None, str(type(v)), v) if not isinstance(v, tuple) else (False, "t", str(v)) for v in row]
    a = sorted((tuple(plain(r[n]) for n in names) for r in spark_df.collect()), key=key)
    at = [relation.columns.index(n) for n in names]
    b = sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{names}: {str(x)[:300]} and {str(y)[:300]}"
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    odd = [(n, k, types[n]) for n, k in spark_df.dtypes if {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}.get(k) != types[n]]
    return f"types {odd}" if odd else None if a else "no rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(sys.argv[1]), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if any(name.startswith(p) for p in sys.argv[2:] or [""]) and (len(sys.argv) > 2 or name[:2] != "op" and name != "pipeline"):
            began = time.time()
            try:
                df = f(spark, sys.argv[1])
                said = compare(df, con.sql(sql[name])) if name in sql else f"rows only: {df.count()}"
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__} {str(e)[:700]}"
            if said:
                bad += name in sql
                print(name, f"{time.time() - began:.1f} s", said, flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
