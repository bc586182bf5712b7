"""Writers: partitioned and row-bounded Parquet, and SQL text for vector stores."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.canonical import partition_key


def write_partitioned(df: DataFrame, path: str, by: str = "jurisdiction_code", *, rows_per_file: int = 1_000_000) -> None:
    """Hive partitions by the lower-cased key, blank as Spark's null partition, files of at most rows_per_file rows.

    Rows meet by key before the write, so that a partition has few files; a large key is spread by AQE's rebalancing.
    """
    keyed = df.withColumn(by, partition_key(F.col(by)))
    keyed.hint("rebalance", by).write.option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def write_chunked(df: DataFrame, path: str, *, rows_per_file: int = 1_000_000) -> None:
    """Flat files of at most rows_per_file rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


OPERATORS = {"cosine": "<=>", "l2": "<->", "ip": "<#>"}
OPCLASSES = {"cosine": "vector_cosine_ops", "l2": "vector_l2_ops", "ip": "vector_ip_ops"}


def _name(x: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", x):
        raise ValueError(f"not an identifier: {x!r}")
    return x


def create_table_sql(table: str, vectors: dict[str, int], *, id_col: str = "id", text_cols: Sequence[str] = ("text",), metadata: bool = False, store: str = "postgres") -> str:
    """DDL of a table with an id, text columns and vectors (column: dimensions), for Postgres vectors or DuckDB arrays."""
    kind = (lambda n: f"vector({int(n)})") if store == "postgres" else (lambda n: f"FLOAT[{int(n)}]")
    columns = [f"{_name(id_col)} TEXT PRIMARY KEY", *(f"{_name(c)} TEXT" for c in text_cols), *(f"{_name(c)} {kind(n)}" for c, n in vectors.items())]
    columns += ["metadata JSONB" if store == "postgres" else "metadata JSON"] if metadata else []
    return f"CREATE TABLE IF NOT EXISTS {_name(table)} ({', '.join(columns)})"


def create_index_sql(table: str, *, vector_col: str = "embedding", distance: str = "cosine", name: str | None = None, m: int = 16, ef_construction: int = 64) -> str:
    return f"CREATE INDEX IF NOT EXISTS {_name(name or f'{table}_{vector_col}_hnsw')} ON {_name(table)} USING hnsw ({_name(vector_col)} {OPCLASSES[distance]}) WITH (m = {int(m)}, ef_construction = {int(ef_construction)})"


def upsert_sql(table: str, *, id_col: str = "id", text_cols: Sequence[str] = ("text",), vector_cols: Sequence[str] = ("embedding",), metadata: bool = False, mark: str = "%s") -> str:
    columns = [_name(c) for c in (id_col, *text_cols, *vector_cols, *(["metadata"] if metadata else []))]
    updates = ", ".join(f"{c} = EXCLUDED.{c}" for c in columns[1:])
    return f"INSERT INTO {_name(table)} ({', '.join(columns)}) VALUES ({', '.join([mark] * len(columns))}) ON CONFLICT ({columns[0]}) DO UPDATE SET {updates}"


def nearest_sql(table: str, *, limit: int, distance: str = "cosine", vector_col: str = "embedding", select: Sequence[str] = ("id", "text"), where: str | None = None, store: str = "postgres") -> str:
    """A nearest-neighbour query with one vector parameter: an index operator in Postgres, an exact scan in DuckDB."""
    forms = {"cosine": "list_cosine_distance({0}, ?)", "l2": "list_distance({0}, ?)", "ip": "-list_dot_product({0}, ?)"}
    column = _name(vector_col)
    measure = f"{column} {OPERATORS[distance]} %s" if store == "postgres" else forms[distance].format(column)
    return f"SELECT {', '.join(map(_name, select))}, {measure} AS distance FROM {_name(table)}{f' WHERE {where}' if where else ''} ORDER BY distance LIMIT {int(limit)}"
