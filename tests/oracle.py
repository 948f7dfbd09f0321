"""Run registered queries against their SQL twins in DuckDB and report differences."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
    "timestamp": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


def compare(df, con, sql) -> str | None:
    """None when both sides agree in columns, types and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    wanted = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for name, kind in df.dtypes:
        if wanted and _TYPES.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    wanted = _rows(names, wanted)
    if got == wanted:
        return None
    extra = [r for r in got if r not in set(wanted)][:3] if len(got) < 50_000 else []
    lacking = [r for r in wanted if r not in set(got)][:3] if len(got) < 50_000 else []
    return f"rows {len(got)} vs {len(wanted)}\n  only spark {extra}\n  only sql {lacking}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from footfall.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "oracle",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    wanted = sys.argv[1:]
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begun = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, con, oracles[name]) if name in oracles else f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28} {time.time() - begun:6.1f}s {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
