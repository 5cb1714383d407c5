"""Side-by-side run of a named query and its SQL counterpart."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
KINDS = {"int": "int", "bigint": "bigint", "double": "double", "string": "string", "boolean": "boolean", "date": "date"}
DUCK_KINDS = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def differences(df, db, sql: str) -> list[str]:
    """Empty when names, kinds and the multiset of rows agree."""
    result = db.execute(sql)
    duck_names = [d[0] for d in result.description]
    duck_kinds = {n: str(d[1]) for n, d in zip(duck_names, result.description)}
    if sorted(df.columns) != sorted(duck_names):
        return [f"columns {sorted(df.columns)} != {sorted(duck_names)}"]
    problems = []
    for name, kind in df.dtypes:
        other = DUCK_KINDS.get(duck_kinds[name], duck_kinds[name].lower())
        if kind != other and not (kind.startswith("decimal") and other.startswith("decimal") and kind == other):
            problems.append(f"type of {name}: {kind} != {other}")
    order = sorted(duck_names)
    ours = _sorted([tuple(_plain(r[c]) for c in order) for r in df.collect()])
    index = [duck_names.index(c) for c in order]
    theirs = _sorted([tuple(_plain(r[i]) for i in index) for r in result.fetchall()])
    if len(ours) != len(theirs):
        problems.append(f"row count {len(ours)} != {len(theirs)}")
    for a, b in zip(ours, theirs):
        if a != b:
            diff = {c: (x, y) for c, x, y in zip(order, a, b) if x != y}
            problems.append(f"row {dict(zip(order, a))} differs {diff}"[:900])
            break
    return problems
