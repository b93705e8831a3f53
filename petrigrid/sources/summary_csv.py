"""summary.csv: encoding, sink, read-back; evaluation and comparison reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from petrigrid.functions.text import csv_boolean, csv_number, csv_row, csv_text
from petrigrid.operators.counts import CSV_COLUMNS

c = F.col
BOM = "﻿"


def summary_lines(rows: DataFrame) -> DataFrame:
    """Encoded lines per project: a header with BOM, then one line per row (SNK1)."""
    kinds = dict(rows.dtypes)
    cell = lambda n: csv_boolean(c(n)) if kinds[n] == "boolean" else csv_text(c(n)) if kinds[n] == "string" else csv_number(c(n))
    body = rows.select("project_id", F.lit(1).alias("part"), "image_id", "annotation_group_id", csv_row([cell(n) for n in CSV_COLUMNS]).alias("value"))
    head = rows.select("project_id").distinct().select("project_id", F.lit(0).alias("part"), F.lit(None).cast(kinds["image_id"]).alias("image_id"), F.lit(None).cast("string").alias("annotation_group_id"), F.lit(BOM + ",".join(CSV_COLUMNS)).alias("value"))
    return head.unionByName(body)


def write_summary(rows: DataFrame, path: str) -> None:
    """One file per project, CRLF line ends, header first (SNK1)."""
    lines = summary_lines(rows).repartition("project_id").sortWithinPartitions("project_id", "part", "image_id", "annotation_group_id")
    lines.select("project_id", "value").write.mode("overwrite").partitionBy("project_id").option("lineSep", "\r\n").text(path)


_NUM = {"confirmed_count", "manual_count", "automated_accepted_count", "automated_unreviewed_count", "image_width", "image_height", "image_id"}
_BOOL = {"group_hidden", "group_locked"}


def summary_schema() -> T.StructType:
    kind = lambda n: T.LongType() if n in _NUM else T.BooleanType() if n in _BOOL else T.StringType()
    return T.StructType([T.StructField(n, kind(n)) for n in CSV_COLUMNS])


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Read summary files back (SNK2); quoted cells may hold line breaks."""
    r = spark.read.schema(summary_schema()).option("header", True).option("enforceSchema", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = r.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    text = [f.name for f in summary_schema() if isinstance(f.dataType, T.StringType)]
    return df.fillna("", text)


def fixed(value: Column, places: int) -> Column:
    """A number with so many places, rounded from its exact binary value as C does, ties to even.

    Java's formatter, behind ``format_string``, rounds the shortest decimal text half up: 0.0625 is 0.063 there.
    """

    @pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:.{places}f}", na_action="ignore").astype(object)

    return text(value.cast("double"))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Table lines of a report (SNK6)."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c(n).cast("string"), F.lit("–")) for n in columns]), F.lit(" |")).alias("value"))


def comparison_json(comparisons: DataFrame) -> DataFrame:
    """Shareable JSON per comparison, numbers rounded to two decimals, no pixels (SNK5)."""
    r2 = lambda n: (F.floor(c(n) * 100 + 0.5) / 100).alias(n)
    counts = F.struct("n_gt", "n_pred", c("tp").alias("matched"), c("fn").alias("missed"), c("fp").alias("extra"), r2("precision"), r2("recall"), r2("f1"))
    body = F.struct(F.lit("region-comparison").alias("kind"), F.lit(1).alias("version"), c("image_id").alias("image"), F.struct(r2("radius")).alias("matching"), counts.alias("counts"))
    return comparisons.select("image_id", F.to_json(body).alias("value"))
