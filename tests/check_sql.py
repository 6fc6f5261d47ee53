"""Compare registered queries with their SQL: python tests/check_sql.py FOLDER [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sitelode.plans.registry import all_queries, all_sql
from sitelode.plans.views import BASE


def plain(value):
    """A comparable form: numbers by value, lists as tuples, NaN as null."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in frame.collect())


def sql_rows(connection, text):
    result = connection.execute(text)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    return [columns[i] for i in order], rows


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def compare(spark, connection, folder, name):
    """None when equal, else a text that says what differs."""
    names, got = spark_rows(all_queries()[name](spark, folder))
    if name not in all_sql():
        return None if sum(got.values()) else "no rows"
    wanted_names, wanted = sql_rows(connection, all_sql()[name])
    if names != wanted_names:
        return f"columns {names} vs {wanted_names}"
    if got != wanted:
        extra, missing = got - wanted, wanted - got
        return (
            f"rows {sum(got.values())} vs {sum(wanted.values())}; only spark {sum(extra.values())} "
            f"{list(extra)[:2]}; only sql {sum(missing.values())} {list(missing)[:2]}"
        )
    return None


if __name__ == "__main__":
    from sitelode.session import local_session

    where, wanted_queries = sys.argv[1], sys.argv[2:] or list(all_queries())
    session, database = local_session(8), connect(where)
    failed = 0
    for query_name in wanted_queries:
        start = time.time()
        try:
            problem = compare(session, database, where, query_name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{query_name}: {'ok' if problem is None else problem} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(wanted_queries) - failed} of {len(wanted_queries)} equal")
