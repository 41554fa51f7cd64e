"""DuckDB over the test tables, and comparison of results."""

from __future__ import annotations

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def same(got, want) -> bool:
    columns = sorted(want.columns)
    if sorted(got.columns) != columns:
        return False
    order = lambda df: df[columns].astype(str).replace({"<NA>": "nan", "None": "nan"}).sort_values(columns).values.tolist()
    return order(got) == order(want)
