"""Run queries and their SQL side by side: python tests/oracle.py [folder] [names...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    def plain(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return None
        return value.item() if hasattr(value, "item") else value
    rows = [tuple(plain(value) for value in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=repr)


def compare(spark, folder, name, run, sql):
    """Differences as text, or none."""
    start = time.time()
    got = run(spark, folder).toPandas()
    spark_seconds = time.time() - start
    if sql is None:
        return None, len(got), spark_seconds, 0.0
    start = time.time()
    wanted = connect(folder).execute(sql).df()
    sql_seconds = time.time() - start
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {list(got.columns)} / {list(wanted.columns)}", len(got), 0, 0
    a, b = canonical(got), canonical(wanted)
    if a == b:
        return None, len(a), spark_seconds, sql_seconds
    first = next((pair for pair in zip(a, b) if pair[0] != pair[1]), None)
    return f"{len(a)} / {len(b)} rows, first difference {first}", len(a), spark_seconds, sql_seconds


if __name__ == "__main__":
    import __spark_entry__ as driver
    from marlpit.runtime import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    sql = driver.oracle_sql()
    for name, run in driver.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            problem, rows, spark_s, sql_s = compare(session, folder, name, run, sql.get(name))
        except Exception as error:  # noqa: BLE001
            problem, rows, spark_s, sql_s = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0, 0
        kind = "rows-only" if name not in sql else "ok" if problem is None else "DIFF"
        print(f"{name:26} {kind:10} {rows:7} rows  {spark_s:6.2f}s  sql {sql_s:6.2f}s  {problem or ''}",
              flush=True)
