"""Business records made from the driver's tables, by the same expressions in Spark and in SQL.

`part`: names, types and brands of parts as names, addresses and countries. `docs`: the first words and characters of
documents, by language. Records of source 1 look for those of sources 2 and 3; a record's source is its key modulo 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.links import collect_links, count_alike

PART_SQL = """rec AS (
  SELECT 'S' || (1 + p_partkey % 3) || '-' || p_partkey AS entity_id, p_name || ' ' || p_type AS business_name,
    CASE WHEN p_partkey % 2 = 0 THEN (1000 + p_size) || ' ' || p_type || ' ' || p_brand
         ELSE p_size || ' ' || p_type || ' ' || p_brand || ' ' || floor(p_retailprice)::bigint END AS business_address,
    p_brand AS country, p_name AS same
  FROM part)"""
DOCS_SQL = """rec AS (
  SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS business_name,
    substr(text, 1, 80) AS business_address, lang AS country, md5(text) AS same
  FROM documents)"""


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Few bytes are many rows here: one small file would be one task for all normalisation.
    p = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(spark.sparkContext.defaultParallelism * 2, "p_partkey")
    even = F.concat_ws(" ", (1000 + F.col("p_size")).cast("string"), "p_type", "p_brand")
    odd = F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", "p_brand", F.floor("p_retailprice").cast("string"))
    return p.select(
        F.concat(F.lit("S"), (1 + F.col("p_partkey") % 3).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.concat_ws(" ", "p_name", "p_type").alias("business_name"),
        F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd).alias("business_address"), F.col("p_brand").alias("country"), F.col("p_name").alias("same"),
    )


def docs_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.substring_index("text", " ", 4).alias("business_name"),
        F.substring("text", 1, 80).alias("business_address"), F.col("lang").alias("country"), F.md5("text").alias("same"),
    )


class Fixture:
    """Sources, targets and truth of one of the two."""

    def __init__(self, records: DataFrame):
        self.records = records.drop("same")
        first = F.col("entity_id").startswith("S1-")
        self.sources, self.targets = self.records.filter(first), self.records.filter(~first)
        s = records.filter(first).select(F.col("entity_id").alias("s1_id"), "country", "same")
        t = records.filter(~first).select(F.col("entity_id").alias("target_id"), "country", "same")
        self.links = s.join(t, ["country", "same"]).select("s1_id", "target_id")
        self.truth = collect_links(self.links)
        # Records that know their links: a link is two equal values of `same`, null without a country.
        known = records.withColumn("same", F.when(F.col("country").isNotNull(), F.col("same")))
        self.known_sources, self.known_targets = known.filter(first), known.filter(~first)
        self.count = count_alike(self.known_sources, self.known_targets, ("country", "same"))


def part(spark: SparkSession, sf_dir: str) -> Fixture:
    return Fixture(part_records(spark, sf_dir))


def docs(spark: SparkSession, sf_dir: str) -> Fixture:
    return Fixture(docs_records(spark, sf_dir))
