"""Catchment tables derived from the star-schema test tables, for queries at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Lazy tables over a folder of Parquet tables; only the columns needed are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, *columns: str) -> DataFrame:
        """A table's columns for costly work on each row: dealt out if it comes in fewer splits than there are cores.

        Large tables come in many splits and are read as they are.
        """
        df, cores = self.table(name).select(*columns), self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    @property
    def municipalities(self) -> DataFrame:
        both = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return both.select(F.col("n_nationkey").cast("long").alias("id"), F.concat_ws("_", "n_nationkey", F.lower("r_name")).alias("name"), F.col("r_name").alias("region"))

    @property
    def schools(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("municipality_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("address"))

    @property
    def decrees(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("municipality_id"), F.concat(F.lit("D-"), "n_nationkey").alias("number"), F.lit("06.03.2025").alias("date"), F.lit(None).cast("string").alias("file_path"))

    @property
    def rules(self) -> DataFrame:
        owner = self.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("school_id"))
        part = self.table("part").join(owner, F.col("p_partkey") == F.col("l_partkey"))
        part = part.join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("school_id") == F.col("s_suppkey")).join(self.municipalities.select(F.col("id").alias("mid"), F.col("name").alias("town")), F.col("s_nationkey") == F.col("mid"))
        key, size = F.col("p_partkey"), F.col("p_size")
        parity = F.when(key % 5 == 0, "even").when(key % 5 == 1, "odd").otherwise("all")
        kind = F.create_map(*[F.lit(x) for x in ("ECONOMY", "range", "LARGE", "up_to", "MEDIUM", "from_to_end", "PROMO", "exact_list", "SMALL", "all", "STANDARD", "all_except")])[F.col("p_type")]
        listed = F.concat(size.cast("string"), F.lit(","), (size + 1).cast("string"), F.lit("а"))
        note = F.when(kind.isin("all", "all_except"), "").when(key % 5 == 0, " (четные)").when(key % 5 == 1, " (нечетные)").otherwise("")
        raw = (
            F.when(kind == "range", F.concat(size.cast("string"), F.lit("-"), (size + 10).cast("string")))
            .when(kind == "up_to", F.concat(F.lit("до дома "), (size + 10).cast("string")))
            .when(kind == "from_to_end", F.concat(F.lit("начиная с дома "), size.cast("string")))
            .when(kind == "exact_list", listed)
            .when(kind == "all", "все")
            .otherwise(F.concat(F.lit("кроме д."), size.cast("string")))
        )
        prefix = F.when(key % 4 == 0, "ул. ").when(key % 4 == 1, "пр-кт ").when(key % 4 == 2, "Шоссе ").otherwise("")
        return part.select(
            key.alias("id"),
            "school_id",
            F.col("s_nationkey").cast("long").alias("decree_id"),
            F.when(key % 3 == 0, F.concat("town", F.lit("n"))).alias("locality"),
            F.concat(prefix, "p_name").alias("street"),
            F.concat(raw, note).alias("house_rule_raw"),
            kind.alias("rule_type"),
            parity.alias("parity"),
            F.when(kind.isin("range", "from_to_end"), size).alias("house_from"),
            F.when(kind.isin("range", "up_to"), size + 10).alias("house_to"),
            F.when(kind == "exact_list", listed).alias("house_number"),
            F.lit(None).cast("string").alias("house_numbers"),
            F.when(kind.isin("all", "all_except"), size.cast("string")).alias("exceptions"),
        )

    @property
    def addresses(self) -> DataFrame:
        orders, customer = self.table("orders").select("o_orderkey", "o_custkey"), self.table("customer").select("c_custkey", "c_nationkey")
        streets = self.table("part").select("p_partkey", "p_name")
        both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(self.municipalities.select("id", "name"), F.col("c_nationkey") == F.col("id"))
        both = both.join(streets, F.col("o_orderkey") % 200 == F.col("p_partkey"))
        house = F.concat((F.col("o_orderkey") % 60 + 1).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "а").otherwise(""))
        return both.select(F.col("o_orderkey").alias("address_id"), F.col("name").alias("locality"), F.concat(F.lit("ул "), "p_name").alias("street"), house.alias("house"))
