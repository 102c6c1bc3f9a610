"""Audits of raw records, ground truth and true pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.normalise import digit_set
from tessera.functions.similarity import levenshtein_ratio, measures, set_jaccard


def fields(records: DataFrame) -> DataFrame:
    """One row of each field: rows, present, distinct, empty, least, average, median and greatest length."""
    long = records.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in records.columns])).alias("x")).select("x.*")
    n = F.length("v")
    return long.groupBy("field").agg(F.count("*").alias("rows"), F.count("v").alias("present"), F.count_distinct("v").alias("different"), F.count_if(F.col("v") == "").alias("empty"), F.min(n).alias("shortest"), F.avg(n).alias("average"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("longest"))


def countries(records: DataFrame) -> DataFrame:
    """(country, n), the largest first."""
    return records.groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country")


def match_histogram(truth: DataFrame) -> DataFrame:
    """(match_count, sources, percent) of sources with their match counts."""
    n = truth.groupBy("match_count").agg(F.count("*").alias("sources"))
    return n.withColumn("percent", F.round(100 * F.col("sources") / F.sum("sources").over(Window.partitionBy()), 6))


def match_stats(truth: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("match_count", F.lit(p))
    return truth.agg(F.count("*").alias("sources"), F.sum("match_count").alias("links"), F.min("match_count").alias("least"), F.max("match_count").alias("most"), F.avg("match_count").alias("average"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"))


def prefixes(links: DataFrame) -> DataFrame:
    """(prefix, n, percent) of the targets' id prefixes."""
    n = links.groupBy(F.substring("target_id", 1, 3).alias("prefix")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def frequent_names(records: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent lower-case trimmed names of two records or more."""
    return records.groupBy(F.lower(F.trim("business_name")).alias("name")).agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "name").limit(n)


def shared_multi(links: DataFrame) -> DataFrame:
    """(target_id, n) of targets that several sources link to."""
    return links.groupBy("target_id").agg(F.count("*").alias("n")).filter("n > 1")


def lookalikes(sources: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """(s1_id, target_id): equal lower-case trimmed names in one country that aren't links."""
    key = lambda df, as_: df.select(F.col("entity_id").alias(as_), "country", F.lower(F.trim("business_name")).alias("name"))
    return key(sources, "s1_id").join(key(targets, "target_id"), ["country", "name"]).select("s1_id", "target_id").join(links, ["s1_id", "target_id"], "left_anti")


# Words that tell kinds of noise.
LEGAL = ("pvt", "private", "ltd", "limited", "inc", "corp", "corporation", "llc", "llp", "co", "company")
LANDMARKS = ("near", "opp", "opposite", "behind", "beside", "next to", "above", "floor")
SHORT_STREETS = ("rd", "st", "dr", "ave")
LONG_STREETS = ("road", "street", "drive", "avenue")


def pair_noise(pairs: DataFrame) -> DataFrame:
    """True pairs (s1_id, target_id, s1_name, t_name, s1_addr, t_addr) with their similarities, strength and kinds of noise."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    simple = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))
    p = pairs.select("s1_id", "target_id", *[text(c).alias(c) for c in ("s1_name", "t_name", "s1_addr", "t_addr")])
    p = p.withColumns({"n1": simple(F.col("s1_name")), "n2": simple(F.col("t_name")), "a1": simple(F.col("s1_addr")), "a2": simple(F.col("t_addr"))})
    p = p.withColumn("m", measures(jw=("jaro_winkler", F.col("n1"), F.col("n2")), name_sort=("token_sort", F.col("n1"), F.col("n2")), name_set=("token_set", F.col("n1"), F.col("n2")), addr_sort=("token_sort", F.col("a1"), F.col("a2")), addr_set=("token_set", F.col("a1"), F.col("a2"))))
    both = (F.col("a1") != "") & (F.col("a2") != "")
    p = p.select("*", "m.jw", "m.name_sort", "m.name_set", F.when(both, F.col("m.addr_sort")).otherwise(0.0).alias("addr_sort"), F.when(both, F.col("m.addr_set")).otherwise(0.0).alias("addr_set"), levenshtein_ratio(F.col("n1"), F.col("n2")).alias("lev"), digit_set(F.col("s1_addr")).alias("d1"), digit_set(F.col("t_addr")).alias("d2")).drop("m")
    name, addr = F.col("name_sort"), F.col("addr_sort")
    strength = F.when((name < 0.5) & (addr >= 0.8), "weak_name_strong_addr").when((name >= 0.8) & (addr < 0.5), "strong_name_weak_addr").when((name >= 0.8) & (addr >= 0.8), "both_strong").when((name < 0.5) & (addr < 0.5), "both_weak").otherwise("between")
    words = lambda c: F.array_distinct(F.split(c, " "))
    other = lambda c: F.array_sort(F.array_except(words(c), F.array(*map(F.lit, LEGAL))))
    low = lambda c: F.lower(c)
    any_in = lambda c, ks: F.exists(F.array(*map(F.lit, ks)), lambda k: F.contains(low(c), k))
    tokens = lambda c: F.split(F.trim(low(c)), r"\s+")
    plain = r"[^\x00-\x7F]"
    kinds = {
        "domain_as_name": any_in("t_name", (".com", ".in", ".org")) & ~any_in("s1_name", (".com",)),
        "transliterations_non_latin": F.col("s1_name").rlike(plain) | F.col("t_name").rlike(plain),
        "word_order_changes": (name > 0.85) & (F.col("lev") < 0.65),
        "legal_suffix_variations": (other("n1") == other("n2")) & (F.array_sort(words("n1")) != F.array_sort(words("n2"))),
        "typos_character_corruptions": (F.col("lev") > 0.75) & (F.col("lev") < 0.95) & (name > 0.80),
        "landmark_addresses": any_in("s1_addr", LANDMARKS) | any_in("t_addr", LANDMARKS),
        "number_formats": (F.size("d1") > 0) & (F.size("d2") > 0) & (F.col("d1") != F.col("d2")),
        "address_abbreviations": F.arrays_overlap(tokens("s1_addr"), F.array(*map(F.lit, SHORT_STREETS))) & F.arrays_overlap(tokens("t_addr"), F.array(*map(F.lit, LONG_STREETS))),
        "missing_address_components": ((F.length("s1_addr") > 50) & (F.length("t_addr") < 25)) | ((F.length("t_addr") > 50) & (F.length("s1_addr") < 25)) | (F.col("t_addr") == ""),
        "punctuation_differences": (F.col("s1_name") != F.col("t_name")) & (F.col("n1") == F.col("n2")),
        "name_abbreviations": (F.col("n1") != F.col("n2")) & (F.startswith(F.col("n1"), F.col("n2")) | F.startswith(F.col("n2"), F.col("n1"))),
    }
    return p.select("s1_id", "target_id", "jw", "lev", "name_sort", "name_set", "addr_sort", "addr_set", set_jaccard(F.col("d1"), F.col("d2"), 0.5).alias("num_jaccard"), strength.alias("strength"), *[c.alias(k) for k, c in kinds.items()])


def noise_summary(noise: DataFrame) -> DataFrame:
    """One row: pairs, exact quartiles of the similarities, pairs of each strength and kind of noise."""
    measured = ("jw", "lev", "name_sort", "name_set", "addr_sort", "addr_set", "num_jaccard")
    flags = [f.name for f in noise.schema if f.dataType.simpleString() == "boolean"]
    quantiles = [F.round(F.percentile(c, F.lit(q)), 9).alias(f"{c}_{int(100 * q)}") for c in measured for q in (0.25, 0.5, 0.75)]
    strong = [F.count_if(F.col("strength") == s).alias(s) for s in ("weak_name_strong_addr", "strong_name_weak_addr", "both_strong", "both_weak")]
    return noise.agg(F.count("*").alias("pairs"), *quantiles, *strong, *[F.count_if(F.col(f)).alias(f) for f in flags])
