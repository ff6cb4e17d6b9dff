"""Runs registered queries beside their SQL and compares rows as bags."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(
        tuple(_plain(row[n]) for n in names) for row in (r.asDict() for r in df.collect())
    )


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, Counter(tuple(_plain(row[i]) for i in at) for row in cursor.fetchall())


def differences(spark, con, sf_dir, query, sql):
    """Empty text when equal."""
    left_names, left = spark_rows(query(spark, sf_dir))
    right_names, right = sql_rows(con, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if left != right:
        return (
            f"rows {sum(left.values())} vs {sum(right.values())}; "
            f"only spark {list((left - right).items())[:3]}; "
            f"only sql {list((right - left).items())[:3]}"
        )
    return ""


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from kilnworks.runtime import local_session

    sf_dir = argv[1]
    wanted = argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            if name in oracles:
                text = differences(spark, con, sf_dir, query, oracles[name])
                note = "ok" if not text else text
            else:
                rows = query(spark, sf_dir).count()
                text, note = "", f"rows only {rows}"
        except Exception as error:  # report and go on
            text = note = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(text)
        print(f"{'FAIL' if text else 'pass'} {name} {time.time() - begin:.1f}s {note}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv)))
