"""Reading, writing, seeding and resetting the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DECREES, MUNICIPALITIES, RULES, SCHOOLS, TABLES


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def append(df: DataFrame, folder: str, name: str) -> None:
    """Rules are laid out by normalized street, so that a lookup of few streets skips files by their statistics."""
    if name == "address_rules":
        df = df.repartitionByRange("normalized_street").sortWithinPartitions("normalized_street", "id")
    df.write.mode("append").parquet(f"{folder}/{name}")


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables, where none are."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def reset(spark: SparkSession, folder: str) -> dict[str, int]:
    """Empties all tables; the number of rows that each had, children first."""
    out = {}
    for name in ("address_rules", "schools", "decrees", "municipalities"):
        out[name] = read(spark, folder, name).count()
        spark.createDataFrame([], TABLES[name]).write.mode("overwrite").parquet(f"{folder}/{name}")
    return out


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """A small set of tables: one town, one decree, one school, two rules of one street."""
    rule = lambda i, raw, parity, low, high: (i, 1, 1, None, "Пятилетки", "пятилетки", raw, "unknown", parity, low, high, *[None] * 6, "unchecked", None)
    return {
        "municipalities": spark.createDataFrame([(1, "Березники", "Пермский край")], MUNICIPALITIES),
        "schools": spark.createDataFrame([(1, 1, "МАОУ «СОШ № 1»", None)], SCHOOLS),
        "decrees": spark.createDataFrame([(1, 1, "01-02-252", "06.03.2025", None)], DECREES),
        "address_rules": spark.createDataFrame([rule(1, "19-39 (нечетные)", "odd", 19, 39), rule(2, "22-48 (четные)", "even", 22, 48)], RULES),
    }


def write_text(texts: DataFrame, folder: str) -> None:
    """Full texts of uploaded files, by file name."""
    texts.select("path", "text").write.mode("append").parquet(folder)


def preview(text: str = "text", size: int = 8000) -> F.Column:
    return F.substring(text, 1, size)
