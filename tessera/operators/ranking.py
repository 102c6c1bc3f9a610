"""Scores, top-K lists, de-duplication, stratified splits and exact-size samples; all orders are total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.similarity import token_jaccard

ATTRIBUTES = ("country", "raw_name", "raw_addr", "norm_name", "norm_addr", "postal", "door")


def fetch(pairs: DataFrame, sources: DataFrame, targets: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with both records' ATTRIBUTES as s1_* and t_*, and `extra` columns of the source."""
    s = sources.select(F.col("entity_id").alias("s1_id"), *extra, *[F.col(c).alias(f"s1_{c}") for c in ATTRIBUTES])
    t = targets.select(F.col("entity_id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in ATTRIBUTES])
    return pairs.join(s, "s1_id").join(t, "target_id")


def score(empty_as_zero: bool = False) -> Column:
    """0.6 of the names' token Jaccard and 0.4 of the addresses'."""
    return 0.6 * token_jaccard(F.col("s1_norm_name"), F.col("t_norm_name"), empty_as_zero) + 0.4 * token_jaccard(F.col("s1_norm_addr"), F.col("t_norm_addr"), empty_as_zero)


def top_k(pairs: DataFrame, sources: DataFrame, targets: DataFrame, k: int = 25, extra: tuple[str, ...] = (), empty_as_zero: bool = False) -> DataFrame:
    """The k best candidates of each source with jaccard_score and candidate_rank: by score, passes, then target id.

    Scores are rounded to 12 decimals, so that equal ones tie however they were added up.
    """
    scored = fetch(pairs, sources, targets, extra).withColumn("jaccard_score", F.round(score(empty_as_zero), 12))
    order = Window.partitionBy("s1_id").orderBy(F.desc("jaccard_score"), F.desc("pass_count"), "target_id")
    return scored.withColumn("candidate_rank", F.row_number().over(order).cast("long")).filter(F.col("candidate_rank") <= k)


def budget(pairs: DataFrame, k: int) -> DataFrame:
    """The first k targets of each source by id, without a score."""
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("s1_id").orderBy("target_id"))).filter(F.col("n") <= k).drop("n")


def deduplicate(records: DataFrame, first: Column | None = None, key: str = "entity_id") -> DataFrame:
    """One record of each key: of those where `first` is largest, the smallest by all columns."""
    order = [*([first.desc()] if first is not None else []), *[F.col(c).asc_nulls_last() for c in records.columns]]
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


DIGEST_DIGITS = 3
"""Hexadecimal digits of an MD5 that deal rows into tasks: a stratum has up to 16 to this power of them."""


def digest_rank(records: DataFrame, strata: list[Column], digest: Column, key: str = "entity_id") -> DataFrame:
    """Records with `_rank`, from 1, by digest and key within their stratum, and `_of`, the stratum's rows.

    No task sees a whole stratum: digests are spread evenly, so rows are ranked among those whose digests begin alike,
    and the counts of the earlier beginnings are added.
    """
    keys = [f"_k{i}" for i in range(len(strata))]
    rows = records.withColumns({"_digest": digest, **dict(zip(keys, strata, strict=True))}).withColumn("_head", F.substring("_digest", 1, DIGEST_DIGITS))
    counts = rows.groupBy(*keys, "_head").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    counts = counts.select(*keys, "_head", (F.sum("_n").over(whole.orderBy("_head")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_of"))
    within = F.row_number().over(Window.partitionBy(*keys, "_head").orderBy("_digest", key))
    r, c = rows.withColumn("_rank", within).alias("r"), counts.alias("c")
    same = F.col("r._head") == F.col("c._head")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    return r.join(c, same).select(*[F.col(f"r.{x}") for x in records.columns], (F.col("r._rank") + F.col("c._before")).alias("_rank"), "c._of")


def split(records: DataFrame, strata: tuple[str, ...] = ("country", "is_singleton"), validation: float = 0.2, key: str = "entity_id") -> DataFrame:
    """Records with `split`: of each stratum, in the order of the ids' MD5, the first 1 - validation train."""
    ranked = digest_rank(records, [F.col(s) for s in strata], F.md5(F.col(key)), key)
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_of") * (1.0 - validation), "train").otherwise("val")).drop("_rank", "_of")


def first_rows(rows: DataFrame, n: int, bucket: Column, order: list) -> DataFrame:
    """The first n rows by (bucket, *order). bucket: any value by which rows fall into a bounded number of buckets.

    The buckets before the one that holds the n-th row are taken whole; only that one's rows are sorted.
    """
    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(Window.orderBy("b")))
    last = counts.filter(F.col("upto") >= n).orderBy("b").select("b", (n - F.col("upto") + F.col("n")).alias("left")).first() if n > 0 else None
    if n <= 0:
        return rows.limit(0)
    if last is None:
        return rows
    return rows.filter(bucket < F.lit(last["b"])).unionByName(rows.filter(bucket == F.lit(last["b"])).orderBy(*order).limit(last["left"]))


def sample(records: DataFrame, n: int, seed: int = 42, key: str = "entity_id") -> DataFrame:
    """Exactly n records (or all, if fewer), the same however they are partitioned: those with the smallest seeded MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))
    return first_rows(records, n, F.substring(digest, 1, DIGEST_DIGITS + 1), [digest, key])
