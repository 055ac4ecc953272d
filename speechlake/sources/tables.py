"""Typed scans of stored tables and partitioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Schemas that scans are held to; a table may have more columns.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string",
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table with the columns and types of its schema; no inference where one is known."""
    path = f"{folder}/{name}.parquet"
    found = spark.read.parquet(path)
    if name not in SCHEMAS:
        return found
    from pyspark.sql.types import StructType

    return found.select(*(found[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])))


def write(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet by partition columns; one shuffle brings each partition's rows together before they are written."""
    rows = df.repartition(*partitions) if partitions else df
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(path)
