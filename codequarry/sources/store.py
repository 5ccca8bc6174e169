"""The index on disk: declared schemas, create-if-missing, append, replace and delete over Parquet.

Tables are folders partitioned by project. An append adds files; a change reads and rewrites the folders of the projects that
it touches and no others, by Spark's dynamic partition overwrite.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import cut

SCHEMAS = {
    "code_chunks": "id string, project_path string, file_path string, content string, summary string, start_line int, end_line int, language string, "
    "chunk_type string, fqn string, parent_id string, metadata string, vector array<float>, summary_vector_json string, file_hash string",
    "dependency_graph": "source_id string, target_id string, source_file string, target_file string, project_path string, import_name string, line int",
    "graph_nodes": "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, "
    "start_column int, end_column int, is_exported boolean, project_path string, metadata string",
    "graph_edges": "source string, target string, kind string, project_path string, metadata string, line int",
    "instances": "id string, project_path string, base_url string, port int, pid int, status string, started_at bigint, updated_at bigint",
    "active_sessions": "project_path string, session_id string, mode string, updated_at bigint",
    "projects": "scope string, path string, label string, updated_at bigint",
}


def changed_partitions(table: DataFrame, rows: DataFrame, gone: DataFrame, keys: Sequence[str], folder: str, partition: str = "project_path") -> None:
    """Rewrites the partitions of ``folder`` that a change touches: rows with a key of ``gone`` leave, ``rows`` come.

    ``table`` is the folder as read. Both frames of the change have the partition column. The new content is a checkpoint
    before anything is overwritten, so a lost executor loses nothing, and doing the same change again changes nothing. A
    partition that is left without rows is emptied. What the driver holds is a value for each partition that is touched.
    """
    spark = table.sparkSession
    rows, gone = cut(rows.select(*table.columns)), cut(gone.select(*keys).distinct())
    touched = rows.select(partition).unionByName(gone.select(partition) if partition in keys else table.join(gone, list(keys), "left_semi").select(partition)).distinct()
    values = [r[0] for r in touched.collect()]
    mine = table.where(mine_of(partition, values))
    same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
    kept = mine.join(gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]), same, "left_anti")
    full = cut(kept.unionByName(rows))
    before = {unquote(m[1]) for r in mine.select(F.input_file_name().alias("f")).distinct().collect() if (m := re.search(rf"/({partition}=[^/]*)/", r.f))}
    full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)
    after = {r[0] for r in full.select(partition).distinct().collect()}
    if len(after) < len(values):
        held = {unquote(m[1]) for r in spark.read.schema(table.schema).parquet(folder).where(mine_of(partition, after)).select(F.input_file_name().alias("f")).distinct().collect() if (m := re.search(rf"/({partition}=[^/]*)/", r.f))}
        for name in before - held:
            full.limit(0).drop(partition).write.mode("overwrite").parquet(f"{folder}/{name}")


def mine_of(partition: str, values: Iterable) -> Column:
    """Whether a row belongs to one of the partitions, null being one."""
    values = list(values)
    return F.coalesce(F.col(partition).isin([v for v in values if v is not None]), F.lit(False)) | (F.col(partition).isNull() if None in values else F.lit(False))


class Store:
    """Tables in folders below ``root``, partitioned by project where they have one, so a project's rows are pruned to its folder.

    A row that doesn't fit the schema is refused; nothing is dropped to make it fit. Appends of several writers don't disturb
    each other; changes of one project are for one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """The table as last written; empty with its schema if it never was."""
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        try:
            return self.spark.read.schema(schema).parquet(self.folder(name)).select(*schema.names)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _fit(self, name: str, rows: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        missing = [c for c in rows.columns if c not in schema.names]
        if missing:
            raise ValueError(f"{name} has no columns {missing}")
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        fit = lambda f: F.col(f.name) if kinds.get(f.name) == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name) if f.name in kinds else F.lit(None).cast(f.dataType).alias(f.name)
        return rows.select(*map(fit, schema.fields))

    def append(self, name: str, rows: DataFrame) -> None:
        out = self._fit(name, rows).write.mode("append")
        (out.partitionBy("project_path") if "project_path" in SCHEMAS[name] else out).parquet(self.folder(name))

    def swap(self, name: str, rows: DataFrame, gone: DataFrame, keys: list[str]) -> None:
        """Rows with a key of ``gone`` leave, ``rows`` come."""
        full, rows = self.read(name), self._fit(name, rows)
        if "project_path" in full.columns:
            changed_partitions(full, rows, gone, keys, self.folder(name))
        else:  # the projects themselves: a few rows
            kept = full.join(gone.select(*keys).distinct(), keys, "left_anti")
            cut(kept.unionByName(rows)).write.mode("overwrite").parquet(self.folder(name))

    def replace(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows take the place of all rows with their keys: an upsert that leaves nothing stale."""
        self.swap(name, rows, self._fit(name, rows), keys)

    def delete(self, name: str, where: str) -> None:
        """Without the rows for which the SQL condition is true."""
        full = self.read(name)
        self.swap(name, full.limit(0), full.where(F.coalesce(F.expr(where), F.lit(False))), full.columns)

    def update(self, name: str, where: str, values: dict[str, Column]) -> None:
        """The rows for which the SQL condition is true, with new values in some columns."""
        full = self.read(name)
        hit = full.where(F.coalesce(F.expr(where), F.lit(False)))
        self.swap(name, hit.withColumns(values), hit, full.columns)
