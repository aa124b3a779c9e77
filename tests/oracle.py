"""Compare registered queries with their oracle SQL. Usage: python tests/oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES.split():
        db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, db, name, query, sql, sf_dir):
    """None when both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got_columns, got = _sorted(df.columns, df.collect())
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    want_columns, want = _sorted(columns, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{got_columns}: {a} != {b} ({sum(x != y for x, y in zip(got, want))} of {len(got)})"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from jobtide.session import build_session, clear_scratch

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls, failed = database(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, db, name, query, sqls[name], sf_dir)
            else:
                problem = None if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    clear_scratch(spark)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
