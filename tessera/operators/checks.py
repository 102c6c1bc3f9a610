"""Data-quality checks. Each returns its figures as a one-row frame; require() raises if any isn't 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(figures: DataFrame) -> dict[str, int]:
    """The figures of a one-row frame; raises ValueError with those that aren't 0."""
    row = figures.first().asDict()
    wrong = {k: v for k, v in row.items() if v}
    if wrong:
        raise ValueError(f"checks failed: {wrong}")
    return row


def _one(counts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in counts.items():
        row = df.agg(F.count("*").alias(name))
        out = row if out is None else out.crossJoin(row)
    return out


def split_leaks(split: DataFrame) -> DataFrame:
    """Sources in both splits, sources with several splits, and rows in neither."""
    per = split.groupBy("entity_id").agg(F.count_distinct("split").alias("splits"))
    both = split.filter("split = 'train'").select("entity_id").join(split.filter("split = 'val'").select("entity_id"), "entity_id")
    return _one({"in_both": both, "several": per.filter("splits > 1"), "in_neither": split.filter("split is null or split not in ('train', 'val')")})


def duplicate_ids(records: DataFrame) -> DataFrame:
    return _one({"duplicates": records.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1")})


def topk_faults(topk: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Pairs that occur twice, that the candidates don't have, that rank below k, and sources with more than k."""
    twice = topk.groupBy("s1_id", "target_id").agg(F.count("*").alias("n")).filter("n > 1")
    orphans = topk.join(pairs.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")
    many = topk.groupBy("s1_id").agg(F.count("*").alias("n")).filter(F.col("n") > k)
    return _one({"twice": twice, "orphans": orphans, "below": topk.filter(F.col("candidate_rank") > k), "too_many": many})


def truth_faults(links: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Links to sources, links to targets that aren't there (by file), links that occur twice, links across countries."""
    known = targets.select(F.col("entity_id").alias("target_id"), F.col("country").alias("there"))
    here = sources.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("here"))
    missing = links.join(known, "target_id", "left_anti")
    across = links.join(here, "s1_id").join(known, "target_id").filter("here <> there")
    return _one({
        "to_sources": links.filter(F.col("target_id").startswith("S1-")), "missing_s2": missing.filter(F.col("target_id").like("S2-%")), "missing_s3": missing.filter(F.col("target_id").like("S3-%")),
        "twice": links.groupBy("s1_id", "target_id").agg(F.count("*").alias("n")).filter("n > 1"), "across": across,
    })


def balance_fault(labelled: DataFrame, ratio: float = 3.0) -> DataFrame:
    """1 if there are more than `ratio` negatives for each positive, and one more row."""
    n = labelled.agg(F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives"))
    return n.select((F.col("negatives") > ratio * F.col("positives") + 1).cast("int").alias("too_many_negatives"))
