"""Ground truth: comma lists of links, labels, target pools and hard negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.similarity import measures
from tessera.operators.ranking import deduplicate, digest_rank, first_rows, sample


def explode_links(truth: DataFrame) -> DataFrame:
    """(s1_id, target_id) of (source1_entity_id, matched_entity_ids); ids are trimmed, empty ones left out."""
    ids = F.explode(F.split("matched_entity_ids", ",")).alias("target_id")
    return truth.select(F.col("source1_entity_id").alias("s1_id"), ids).select("s1_id", F.trim("target_id").alias("target_id")).filter("target_id <> ''")


def collect_links(links: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) with sorted, distinct ids."""
    return links.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("matched_entity_ids"))


def with_truth(sources: DataFrame, truth: DataFrame) -> DataFrame:
    """Sources with matched_entity_ids, match_count and is_singleton."""
    joined = sources.join(truth.withColumnRenamed("source1_entity_id", "entity_id"), "entity_id", "left")
    none = F.coalesce(F.trim("matched_entity_ids"), F.lit("")) == ""
    many = F.length("matched_entity_ids") - F.length(F.replace("matched_entity_ids", F.lit(","), F.lit(""))) + 1
    return joined.withColumn("match_count", F.when(none, 0).otherwise(many).cast("long")).withColumn("is_singleton", none.cast("long"))


def target_pool(targets: DataFrame, links: DataFrame, distractors: int, seed: int = 42) -> DataFrame:
    """All linked targets and, of each source file (by id prefix), so many others at most, each once; is_true tells which."""
    true = targets.join(links.select(F.col("target_id").alias("entity_id")).distinct(), "entity_id", "left_semi").withColumn("is_true", F.lit(1))
    other = targets.join(links.select(F.col("target_id").alias("entity_id")), "entity_id", "left_anti")
    other = digest_rank(other, [F.substring("entity_id", 1, 3)], F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("entity_id"))))
    other = other.filter(F.col("_rank") <= distractors).drop("_rank", "_of").withColumn("is_true", F.lit(0))
    return deduplicate(true.unionByName(other), F.col("is_true"))


def label(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs with label 1 if they are links, else 0."""
    known = links.select("s1_id", "target_id").distinct().withColumn("_link", F.lit(1))
    return pairs.join(known, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("_link", F.lit(0))).drop("_link")


def label_alike(pairs: DataFrame, here: str, there: str) -> DataFrame:
    """Pairs with label 1 if two of their columns agree, which makes them links, else 0. The links themselves aren't listed."""
    return pairs.withColumn("label", F.coalesce(F.col(here) == F.col(there), F.lit(False)).cast("int")).drop(here, there)


def count_alike(sources: DataFrame, targets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row: links, how many pairs agree in `by`."""
    n = lambda df, c: df.groupBy(*by).agg(F.count("*").alias(c))
    return n(sources, "_m").join(n(targets, "_n"), list(by)).agg(F.coalesce(F.sum(F.col("_m") * F.col("_n")), F.lit(0)).alias("links"))


def missed_alike(labelled: DataFrame, sources: DataFrame, targets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(s1_id, target_id) of the pairs that agree in `by` and aren't labelled 1. A source brings its found targets along, so links aren't shuffled."""
    found = labelled.filter("label = 1").groupBy("s1_id").agg(F.collect_set("target_id").alias("_found"))
    s = sources.select(F.col("entity_id").alias("s1_id"), *by).join(found, "s1_id", "left")
    t = targets.select(F.col("entity_id").alias("target_id"), *by)
    return s.join(t, list(by)).filter(~F.coalesce(F.array_contains("_found", F.col("target_id")), F.lit(False))).select("s1_id", "target_id")


def inject_missed(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """Labelled pairs and the links that aren't among them. This inflates recall, so nothing does it by default."""
    missed = links.join(labelled, ["s1_id", "target_id"], "left_anti").withColumn("label", F.lit(1))
    return labelled.unionByName(missed, allowMissingColumns=True)


def hardest_negatives(labelled: DataFrame, ratio: float = 3.0) -> DataFrame:
    """The negatives that rank first, `ratio` times as many as there are positives."""
    n = int(labelled.filter("label = 1").count() * ratio)
    bucket = F.col("candidate_rank").cast("long") * 8192 + 4096 - F.floor(F.col("jaccard_score") * 4096)
    return first_rows(labelled.filter("label = 0"), n, bucket, ["candidate_rank", F.desc("jaccard_score"), "s1_id", "target_id"])


def random_negatives(labelled: DataFrame, ratio: float = 3.0, seed: int = 42) -> DataFrame:
    """Negatives by seeded MD5, `ratio` times as many as there are positives."""
    keyed = labelled.filter("label = 0").withColumn("_pair", F.concat_ws("|", "s1_id", "target_id"))
    return sample(keyed, int(labelled.filter("label = 1").count() * ratio), seed, "_pair").drop("_pair")


CATEGORIES = ("high_name_low_addr", "high_addr_low_name", "high_name_conflict_door", "high_addr_diff_name", "generic_name_collision", "remaining_difficult")


def negative_category(name: Column, addr: Column) -> Column:
    """Which kind of hard negative a pair is. name, addr: token sort ratios of names and addresses."""
    doors = (F.col("s1_door") != "") & (F.col("t_door") != "") & (F.col("s1_door") != F.col("t_door"))
    return (
        F.when((name >= 0.80) & (addr < 0.40), CATEGORIES[0]).when((addr >= 0.75) & (name < 0.40), CATEGORIES[1]).when((name >= 0.70) & doors, CATEGORIES[2])
        .when((addr >= 0.70) & (name < 0.60), CATEGORIES[3]).when(F.length(F.replace("s1_norm_name", F.lit(" "), F.lit(""))) <= 5, CATEGORIES[4]).otherwise(CATEGORIES[5])
    )


def categorised_negatives(labelled: DataFrame) -> DataFrame:
    """Negatives with name_sort, addr_sort and category."""
    m = measures(name=("token_sort", F.col("s1_norm_name"), F.col("t_norm_name")), addr=("token_sort", F.col("s1_norm_addr"), F.col("t_norm_addr")))
    scored = labelled.filter("label = 0").withColumn("_m", m)
    return scored.withColumns({"name_sort": F.col("_m.name"), "addr_sort": F.col("_m.addr")}).drop("_m").withColumn("category", negative_category(F.col("name_sort"), F.col("addr_sort")))


def allocate(counts: dict[str, int], total: int) -> dict[str, int]:
    """How many of each category to take: its share rounded down; the last that has any takes what is left, up to its count."""
    filled, left, out = [c for c in counts if counts[c] > 0], total, {}
    everything = sum(counts.values())
    for i, c in enumerate(filled):
        share = left if i == len(filled) - 1 else total * counts[c] // everything
        out[c] = min(share, counts[c], left)
        left -= out[c]
    return out


def sample_negatives(negatives: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """`total` categorised negatives by allocate(), of each category those with the smallest seeded MD5."""
    found = {r[0]: r[1] for r in negatives.groupBy("category").count().collect()}
    share = allocate({c: found.get(c, 0) for c in CATEGORIES}, total)
    wanted = F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.lit(share.get(c, 0)))])
    w = Window.partitionBy("category").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "s1_id", "target_id")), "s1_id", "target_id")
    return negatives.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= wanted[F.col("category")]).drop("_n")


def balanced(labelled: DataFrame, negatives: DataFrame) -> DataFrame:
    """All positives and the chosen negatives."""
    columns = labelled.columns
    return labelled.filter("label = 1").unionByName(negatives.select(columns))
