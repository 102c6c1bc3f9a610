"""Recall of candidates, candidate statistics, per-entity F0.5, threshold grids and error categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

THRESHOLDS = tuple(round(0.30 + 0.05 * i, 2) for i in range(14))


def recall_at(topk: DataFrame, links: DataFrame, depths: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """One row: links, and for each depth the links among the first candidates (hits_k) and their share (recall_k)."""
    ranks = links.join(topk.select("s1_id", "target_id", "candidate_rank"), ["s1_id", "target_id"], "left")
    counts = ranks.agg(F.count("*").alias("links"), *[F.count_if(F.col("candidate_rank") <= k).alias(f"hits_{k}") for k in depths])
    return counts.select("links", *[c for k in depths for c in (F.col(f"hits_{k}"), F.coalesce(F.try_divide(f"hits_{k}", "links"), F.lit(0.0)).alias(f"recall_{k}"))])


def recall_of(labelled: DataFrame, count: DataFrame, depths: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """recall_at() of a labelled list; count: one row with the number of links."""
    hits = labelled.filter("label = 1").agg(*[F.count_if(F.col("candidate_rank") <= k).alias(f"hits_{k}") for k in depths])
    return count.crossJoin(hits).select("links", *[c for k in depths for c in (F.col(f"hits_{k}"), F.coalesce(F.try_divide(f"hits_{k}", "links"), F.lit(0.0)).alias(f"recall_{k}"))])


def pair_recall(pairs: DataFrame, links: DataFrame, sources: int | None = None, targets: int | None = None) -> DataFrame:
    """One row: pairs, links, hits, recall and, with both sizes given, the share of all possible pairs that was spared."""
    hits = pairs.select("s1_id", "target_id").join(links, ["s1_id", "target_id"], "left_semi").agg(F.count("*").alias("hits"))
    row = pairs.agg(F.count("*").alias("pairs")).crossJoin(links.agg(F.count("*").alias("links"))).crossJoin(hits)
    row = row.withColumn("recall", F.coalesce(F.try_divide("hits", "links"), F.lit(0.0)))
    return row if sources is None else row.withColumn("reduction", 1 - F.col("pairs") / F.lit(float(max(1, sources * targets))))


def candidate_stats(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row about the candidates of each source, those without any included: average, exact quantiles, greatest, how many have none."""
    counts = pairs.groupBy("s1_id").agg(F.count("*").alias("n"))
    every = sources.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return every.agg(F.avg("n").alias("average"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("n").alias("greatest"), F.count_if(F.col("n") == 0).alias("without"))


def nearest_rank(pairs: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: rows, entities, and the value at place floor(share * entities) (from 0) of the ascending candidate counts."""
    counts = pairs.groupBy("s1_id").agg(F.count("*").alias("n"))
    return _nearest_rank(counts.groupBy("n").agg(F.count("*").alias("entities")), share)


def _nearest_rank(histogram: DataFrame, share: float) -> DataFrame:
    """nearest_rank() of (n, entities): how many entities have n candidates."""
    upto = histogram.withColumn("upto", F.sum("entities").over(Window.orderBy("n"))).withColumn("all", F.sum("entities").over(Window.partitionBy()))
    at = F.min(F.when(F.col("upto") > F.floor(F.col("all") * share), F.col("n")))
    return upto.agg(F.sum(F.col("n") * F.col("entities")).alias("rows"), F.sum("entities").alias("entities"), at.alias("value"))


def of_classes(lists: DataFrame, sources: DataFrame, targets: DataFrame, count: DataFrame, depths: tuple[int, ...] = (10, 25, 50), share: float = 0.95) -> DataFrame:
    """nearest_rank() and recall_at() in one row, of lists that classes of sources share: no list is given to its sources.

    lists: (_class, target_id, candidate_rank); sources: (_class, same); targets: (target_id, same). Pairs of equal `same` are links; count: one row with their number.
    """
    members = sources.groupBy("_class", "same").agg(F.count("*").alias("m"))
    sizes = lists.groupBy("_class").agg(F.count("*").alias("n")).join(members.groupBy("_class").agg(F.sum("m").alias("m")), "_class")
    hits = lists.filter(F.col("candidate_rank") <= max(depths)).join(targets, "target_id").groupBy("_class", "same").agg(*[F.count_if(F.col("candidate_rank") <= k).alias(f"h_{k}") for k in depths])
    sums = hits.join(members, ["_class", "same"]).agg(*[F.coalesce(F.sum(F.col("m") * F.col(f"h_{k}")), F.lit(0)).alias(f"hits_{k}") for k in depths])
    recall = count.crossJoin(sums).select("links", *[c for k in depths for c in (F.col(f"hits_{k}"), F.coalesce(F.try_divide(f"hits_{k}", "links"), F.lit(0.0)).alias(f"recall_{k}"))])
    return _nearest_rank(sizes.groupBy("n").agg(F.sum("m").alias("entities")), share).crossJoin(recall)


def f_half(hits: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of an entity: 1 if nothing is true or predicted, 0 if only one side is empty or nothing is hit."""
    p, r = F.try_divide(hits, predicted), F.try_divide(hits, true)
    return F.when((predicted == 0) & (true == 0), 1.0).when((predicted == 0) | (true == 0) | (hits == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_scores(predictions: DataFrame, links: DataFrame, sources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, s1_id, hits, predicted, true, f) of every source, whether predicted or not.

    predictions: (*by, s1_id, target_id) with a row for each value of `by` in `sources`.
    """
    marked = predictions.join(links.withColumn("_link", F.lit(1)), ["s1_id", "target_id"], "left")
    made = marked.groupBy(*by, "s1_id").agg(F.count("*").alias("predicted"), F.count("_link").alias("hits"))
    true = links.groupBy("s1_id").agg(F.count("*").alias("true"))
    every = sources.join(true, "s1_id", "left").join(made, [*by, "s1_id"], "left").na.fill(0, ["hits", "predicted", "true"])
    return every.select(*by, "s1_id", "hits", "predicted", "true", f_half(F.col("hits"), F.col("predicted"), F.col("true")).alias("f"))


def summarise(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro F0.5, micro precision and recall, false positives and negatives, and matches per entity, for each `by`."""
    sums = scores.groupBy(*by).agg(F.avg("f").alias("macro_f05"), F.sum("hits").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("true").alias("true"), F.avg("predicted").alias("avg_matches_per_s1"))
    return sums.select(
        *by, "macro_f05", F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "true"), F.lit(0.0)).alias("recall"),
        (F.col("predicted") - F.col("tp")).alias("false_positives"), (F.col("true") - F.col("tp")).alias("false_negatives"), "avg_matches_per_s1",
    )


def threshold_grid(scored: DataFrame, links: DataFrame, sources: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """summarise() for each threshold. scored: (s1_id, target_id, probability); a pair is predicted from its threshold up.

    A pair's highest threshold is found once; an entity's counts at all thresholds are sums over its pairs, so no pair is repeated.
    """
    marked = scored.join(links.withColumn("_link", F.lit(1)), ["s1_id", "target_id"], "left")
    sums = [c for i, t in enumerate(thresholds) for c in (F.count_if(F.col("probability") >= t).alias(f"p{i}"), F.count_if((F.col("probability") >= t) & F.col("_link").isNotNull()).alias(f"h{i}"))]
    made = marked.groupBy("s1_id").agg(*sums)
    true = links.groupBy("s1_id").agg(F.count("*").alias("true"))
    every = sources.select("s1_id").join(true, "s1_id", "left").join(made, "s1_id", "left").na.fill(0)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("predicted"), F.col(f"h{i}").alias("hits")) for i, t in enumerate(thresholds)]))
    flat = every.select("s1_id", "true", rows.alias("x")).select("s1_id", "true", "x.*")
    return summarise(flat.withColumn("f", f_half(F.col("hits"), F.col("predicted"), F.col("true"))), ("threshold",))


def best_threshold(grid: DataFrame) -> tuple[float, float]:
    """(threshold, macro F0.5): the first of the best."""
    r = grid.orderBy(F.desc("macro_f05"), "threshold").select("threshold", "macro_f05").first()
    return float(r[0]), float(r[1])


def false_positive_category(name: Column, addr: Column, short_either_side: bool = False) -> Column:
    """name, addr: token sort ratios. Short names are up to 5 letters of the source, or up to 6 characters on either side."""
    doors = (F.col("s1_door") != "") & (F.col("t_door") != "") & (F.col("s1_door") != F.col("t_door"))
    short = F.length(F.replace("s1_norm_name", F.lit(" "), F.lit(""))) <= 5
    if short_either_side:
        short = (F.length("s1_norm_name") <= 6) | (F.length("t_norm_name") <= 6)
    return (
        F.when((name >= 0.85) & (addr < 0.40), "same_name_diff_address").when((addr >= 0.80) & (name < 0.40), "same_address_diff_business")
        .when(doors & (name >= 0.70), "address_number_conflict").when(short, "abbreviation_collision").otherwise("generic_name_collision")
    )


def false_negative_category(name: Column, addr: Column, weak_sides: bool = False) -> Column:
    """By what is missing and how alike the names are; with weak_sides by both ratios first."""
    empty = lambda *cs: F.lit(False) | (F.col(cs[0]) == "") | (F.col(cs[1]) == "")
    names, addresses = empty("s1_norm_name", "t_norm_name"), empty("s1_norm_addr", "t_norm_addr")
    if weak_sides:
        return (
            F.when((name < 0.50) & (addr < 0.50), "both_name_addr_weak").when(name < 0.60, "name_typo_or_variation").when(addr < 0.60, "address_typo_or_missing")
            .when(names, "missing_business_name").when(addresses, "missing_address").otherwise("other_low_confidence")
        )
    return (
        F.when(names, "missing_name").when(addresses, "missing_address").when(name < 0.50, "trade_name_or_transliteration")
        .when(name < 0.75, "severe_typo_or_abbrev").otherwise("address_variation")
    )


def miss_category() -> Column:
    """Why blocking missed a link, from s1_* and t_* names and addresses; scripts are told by the target's raw name."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    name, other = F.coalesce("s1_norm_name", F.lit("")), F.coalesce("t_norm_name", F.lit(""))
    shared = F.array_intersect(words(name), words(other))
    no_address = (F.trim("s1_norm_addr") == "") | (F.trim("t_norm_addr") == "")
    longest = F.coalesce(F.array_max(F.transform(shared, F.length)), F.lit(0))
    return (
        F.when(F.coalesce(F.col("t_raw_name"), F.lit("")).rlike(r"[^\x00-\x7F]"), "indic_or_cjk_target_name")
        .when((F.trim(name) == "") & (F.trim(other) == ""), "both_names_missing").when((F.trim(name) == "") | (F.trim(other) == ""), "one_name_missing")
        .when((F.size(shared) == 0) & no_address, "no_name_overlap_no_address").when(F.size(shared) == 0, "no_name_overlap_address_only")
        .when(longest < 4, "only_short_tokens_shared").when(no_address, "name_overlap_no_address").otherwise("other")
    )


def shares(rows: DataFrame, category: str = "category", sources: str | None = None) -> DataFrame:
    """(category, n, percent) of a column. sources: an array column, where a row counts for each of its elements."""
    counts = rows.groupBy(category).agg((F.count("*") if sources is None else F.sum(F.size(sources))).alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def missed_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    return links.join(pairs.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")


def compare(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """The one-row metrics of several strategies under each other, with their names."""
    every = [df.withColumn("strategy", F.lit(name)) for name, df in rows]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def best_strategy(table: DataFrame, recall: str = "recall", pairs: str = "pairs") -> str:
    """The strategy of the highest recall and, of those, the fewest pairs."""
    return table.orderBy(F.desc(recall), pairs, "strategy").first()["strategy"]
