"""Compare every registered query with its SQL twin: ``python -m tests.compare SF_DIR [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, plain(x)) for k, x in value.items())
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


SAME_TYPE = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and the SQL twin's; empty when they are the same."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    got = [tuple(r) for r in df.collect()]
    out = [
        f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}"
        for f in df.schema.fields
        if SAME_TYPE.get(types[f.name], types[f.name]) != f.dataType.simpleString()
    ]
    a, b = rows_of(df.columns, got), rows_of(names, expected)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        out.append(f"values differ\n   columns {sorted(names)}\n   spark {only_a}\n   sql   {only_b}")
    return out


def main() -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from relaylens.session import local_session

    sf_dir, wanted = sys.argv[1], [a for a in sys.argv[2:] if a != "-v"]
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                found = differences(df, con, oracles[name])
                note = "same" if not found else "DIFFERENT " + "; ".join(found)
            else:
                found, note = [], f"rows only: {df.count()}"
        except Exception as error:  # report every query
            found, note = [error], "FAILED " + str(error)[:1500]
        bad += bool(found)
        rows = f" rows={df.count()}" if not found and name in oracles and "-v" in sys.argv else ""
        print(f"{name:34s} {time.time() - begin:6.1f}s {note}{rows}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
