"""Runs registered queries next to their SQL counterparts and reports differences."""

from __future__ import annotations

import glob
import os
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def normal_form(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if str(frame[name].dtype).startswith("datetime"):
            frame[name] = frame[name].astype("datetime64[us]")
        frame[name] = frame[name].map(lambda value: None if pd.isna(value) else value).astype(object)
        frame[name] = frame[name].map(repr_value)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def repr_value(value: object) -> str:
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def type_family(name: str) -> str:
    families = {
        "bigint": "int64", "int": "int32", "INTEGER": "int32", "BIGINT": "int64",
        "HUGEINT": "int128", "double": "double", "DOUBLE": "double", "string": "text",
        "VARCHAR": "text", "boolean": "bool", "BOOLEAN": "bool", "timestamp_ntz": "time",
        "TIMESTAMP": "time", "timestamp": "zoned", "TIMESTAMP WITH TIME ZONE": "zoned",
    }
    return families.get(name, name)


def difference(spark, connection, name, run, oracle, sf_dir) -> tuple[str, float, int]:
    """('' when equal, else a description), seconds the query took, rows."""
    start = time.time()
    result = run(spark, sf_dir)
    ours = result.toPandas()
    took = time.time() - start
    if oracle is None:
        return "", took, len(ours)
    relation = connection.sql(oracle)
    theirs_types = {c: type_family(str(t)) for c, t in zip(relation.columns, relation.types)}
    ours_types = {f.name: type_family(f.dataType.simpleString()) for f in result.schema}
    theirs = relation.df()
    if ours_types != theirs_types:
        return f"schema {ours_types} <> {theirs_types}", took, len(ours)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} <> {len(theirs)}", took, len(ours)
    a, b = normal_form(ours), normal_form(theirs)
    if not a.equals(b):
        wrong = (a != b).any(axis=1)
        return f"{wrong.sum()} rows differ:\n{a[wrong].head(3)}\n{b[wrong].head(3)}", took, len(ours)
    return "", took, len(ours)
