"""Compare registered queries with their SQL texts: ``python tests/oracle_check.py DIR [name...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

DUCKDB_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(rows, names):
    """Rows as sorted tuples, columns in name order."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            if math.isnan(v):
                return "nan"
            return repr(v + 0.0)
        return repr(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def compare(spark, con, name, sf_dir, query, sql) -> str:
    """Empty if both sides agree, else what differs."""
    df = query(spark, sf_dir)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(cursor.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    wrong = [(c, t, types[c]) for c, t in df.dtypes if DUCKDB_TYPES.get(t) != types[c]]
    if wrong:
        return f"types {wrong}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, first {different[0]!r:.600}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries
    from corpusloom.scratch import drop_tables

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = sys.argv[1]
    con = connect(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        if name in sqls:
            try:
                result = compare(spark, con, name, sf_dir, query, sqls[name])
            except Exception as error:
                result = f"error {error!s:.1500}"
        else:
            result = "" if query(spark, sf_dir).collect() else "no rows"
        failed += bool(result)
        print(f"{'FAIL' if result else 'ok':5}{name} {time.time() - start:.1f}s {result}", flush=True)
    print(f"{failed} failed")
    drop_tables(spark)


if __name__ == "__main__":
    main()
