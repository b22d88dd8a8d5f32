"""Local stand-in for the driver's oracle check: run a registered Spark query
and its DuckDB SQL on the same parquet tables and compare row count, schema
and values (order-insensitive)."""

from __future__ import annotations

import math

import duckdb

from panelkit.sources.tables import TABLES

TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE",
            "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]", "array<float>": "FLOAT[]",
            "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]", "tinyint": "TINYINT"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, repr(x)) for x in row)


def compare(spark, con, name, builder, sql, sf_dir, tol=0.0):
    sdf = builder(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_types = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    s_rows = [tuple(_norm(r[c]) for c in s_cols) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = sorted(rel.columns)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    d_raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(rel.columns)}
    d_rows = [tuple(_norm(r[idx[c]]) for c in d_cols) for r in d_raw]
    out = {"name": name, "rows_spark": len(s_rows), "rows_oracle": len(d_rows)}
    out["columns_match"] = s_cols == d_cols
    out["types_match"] = out["columns_match"] and all(s_types[c] == d_types[c] for c in s_cols)
    if not out["types_match"]:
        out["types"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_cols) | set(d_cols)
                        if s_types.get(c) != d_types.get(c)}
    a, b = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    out["values_match"] = a == b
    if not out["values_match"] and len(a) == len(b):
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        out["n_diff"] = len(bad)
        out["example"] = bad[:2]
    elif not out["values_match"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = list(sa - sb)[:2]
        out["only_oracle"] = list(sb - sa)[:2]
    out["ok"] = (out["rows_spark"] == out["rows_oracle"] and out["types_match"]
                 and out["values_match"])
    return out
