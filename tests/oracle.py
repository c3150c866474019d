"""Compare registered queries with their check SQL: names, counts, values.

    python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def differences(spark_df, con, sql: str) -> str:
    names = sorted(spark_df.columns)
    mine = Counter(tuple(plain(r[n]) for n in names) for r in spark_df.toLocalIterator())
    result = con.sql(sql)
    if sorted(result.columns) != names:
        return f"columns {names} against {sorted(result.columns)}"
    at = [result.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    if mine == theirs:
        return ""
    return (
        f"rows {sum(mine.values())} against {sum(theirs.values())}\n  only here: "
        f"{list((mine - theirs).items())[:3]}\n  only there: {list((theirs - mine).items())[:3]}")


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").appName("oracle")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())


if __name__ == "__main__":
    import __spark_entry__ as entry_points

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    checks = entry_points.oracle_sql()
    bad = 0
    for name, query in entry_points.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in checks:
                problem = differences(query(spark, sf_dir), con, checks[name])
                state = "ok" if not problem else "DIFFERS " + problem
            else:
                state = f"rows {query(spark, sf_dir).count()} (no SQL)"
        except Exception as error:
            state = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += state.startswith(("DIFFERS", "ERROR"))
        print(f"{name}: {state} [{time.time() - start:.1f}s]", flush=True)
    print(f"{bad} bad")
    sys.exit(bad > 0)
