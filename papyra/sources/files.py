"""Reading and writing documents and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, text): one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.decode("content", "UTF-8").alias("text"))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", **options) -> None:
    df.write.mode(mode).format(format).options(**options).save(path)


def csv_line(cells: Column) -> Column:
    """An array of strings as a line of CSV: cells are quoted where they hold a comma, a quote or a line break."""
    quoted = lambda c: F.when(c.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, quoted), ",")


def csv_text(tables: DataFrame) -> DataFrame:
    """(doc_id, page_index, csv) of table rows (doc_id, page_index, row, cells)."""
    rows = F.array_sort(F.collect_list(F.struct("row", csv_line(F.col("cells")).alias("line"))))
    return tables.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("csv"))


def json_text(tables: DataFrame) -> DataFrame:
    """(doc_id, page_index, json): rows as arrays of arrays."""
    rows = F.array_sort(F.collect_list(F.struct("row", "cells")))
    return tables.groupBy("doc_id", "page_index").agg(F.to_json(F.transform(rows, lambda r: r.cells)).alias("json"))


def report(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
