"""Writers; Spark's commit protocol replaces whole folders atomically."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def public_columns(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(columns or df.columns).write.mode("overwrite").option("escape", '"').option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_category(df: DataFrame, path: str, category: str, text: str = "text", longest: int = 32_767) -> None:
    """A folder for each category, texts cut to what a sheet's cell holds."""
    df.withColumn(text, F.left(F.col(text), F.lit(longest))).write.mode("overwrite").partitionBy(category).parquet(path)


def payload(df: DataFrame, nulls: bool = False) -> DataFrame:
    """Rows as JSON that may stand inside an HTML script element; missing fields are left out or, on demand, null."""
    return df.select(F.replace(F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(not nulls).lower()}), F.lit("</"), F.lit("<\\/")).alias("json"))
