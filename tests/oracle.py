"""Run queries beside their DuckDB oracles: python tests/oracle.py SF [NAME...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else str(v) if v is not None else None


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in data], key=str)


def compare(spark, con, query, sql, sf_dir):
    """An empty string if rows and names agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    theirs = rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} {sorted(columns)}"
    if mine != theirs:
        odd = [x for x in zip(mine, theirs) if x[0] != x[1]][:2]
        return f"{len(mine)} and {len(theirs)} rows; {odd}"
    return "" if mine else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"/root/testdata/{sys.argv[1]}"
    con, queries, oracles = connect(sf), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or [q for q in queries if not q.startswith("op") and q != "pipeline" or q in oracles]:
        t = time.time()
        try:
            said = compare(spark, con, queries[name], oracles[name], sf) if name in oracles else f"no oracle; {queries[name](spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:300]}"
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
