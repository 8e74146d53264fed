"""Run registered queries in Spark and their SQL in DuckDB, and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if not isinstance(v, (dict, list)) else str(v)) for v in row))


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted([tuple(_plain(v) for v in row) for row in df.select(*names).collect()])


def duck_rows(con, sql):
    cursor = con.cursor()
    cursor.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), _sorted([tuple(_plain(row[i]) for i in order) for row in cursor.fetchall()])


def difference(spark, con, build, sql, sf_dir) -> str | None:
    names, ours = spark_rows(build(spark, sf_dir))
    if sql is None:
        return None if ours else "no rows"
    wanted_names, wanted = duck_rows(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(ours) != len(wanted):
        extra = [r for r in ours if r not in set(wanted)][:2] if len(wanted) < 50000 else []
        lacking = [r for r in wanted if r not in set(ours)][:2] if len(ours) < 50000 else []
        return f"{len(ours)} rows != {len(wanted)}; extra {extra}; lacking {lacking}"
    for a, b in zip(ours, wanted):
        if a != b:
            return f"{a} != {b}"
    return None if ours else "no rows"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from noteskein.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = difference(spark, con, build, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
