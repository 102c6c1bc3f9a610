"""Similarity features of candidate pairs: sets of 14, 24 and 30. Arrow runs once a pair, after the top-K cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.normalise import digit_set
from tessera.functions.similarity import levenshtein_ratio, measures, set_jaccard

# Names and order of the feature sets.
FEATURES_14 = (
    "name_jaro_winkler", "name_token_sort_ratio", "name_token_set_ratio", "name_partial_ratio", "name_exact_match", "name_core_match", "name_len_ratio",
    "addr_token_sort_ratio", "addr_token_set_ratio", "addr_num_jaccard", "addr_postal_match", "addr_door_match", "name_x_addr", "composite_score",
)
FEATURES_24 = (
    "name_exact_raw", "name_exact_norm", "name_token_sort_ratio", "name_token_set_ratio", "name_jaro_winkler", "name_levenshtein_ratio", "name_char_sim", "name_substring_containment",
    "addr_exact_norm", "addr_token_sort_ratio", "addr_token_set_ratio", "addr_token_jaccard", "addr_char_sim", "addr_num_overlap", "addr_postal_match",
    "country_agreement", "s1_name_missing", "t_name_missing", "s1_addr_missing", "t_addr_missing", "candidate_rank", "blocking_pass_count", "name_x_addr", "name_diff_addr",
)
FEATURES_30 = (*FEATURES_24, "norm_rank", "score_margin", "top_score", "name_addr_composite", "rank_x_jaccard", "pass_count_norm")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _both(a: Column, b: Column) -> Column:
    return flag((a != "") & (a == b))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def builtin(k: int = 25, top: Column | None = None) -> dict[str, Column]:
    """The features that built-in functions can compute. top: a source's highest score, if it's known."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    name, other, addr, place = text("s1_norm_name"), text("t_norm_name"), text("s1_norm_addr"), text("t_norm_addr")
    digits = lambda c: F.filter(_words(c), lambda w: w.rlike("^[0-9]+$"))
    longest = F.greatest(F.length(name), F.length(other), F.lit(1))
    top = F.max("jaccard_score").over(Window.partitionBy("s1_id")) if top is None else top
    rank = F.col("candidate_rank").cast("double")
    return {
        "name_exact_raw": _both(text("s1_raw_name"), text("t_raw_name")),
        "name_exact_norm": _both(name, other),
        "name_exact_match": _both(name, other),
        "name_levenshtein_ratio": levenshtein_ratio(name, other),
        "name_substring_containment": flag((name != "") & (other != "") & (F.contains(other, name) | F.contains(name, other))),
        "name_len_ratio": F.least(F.length(name), F.length(other)) / longest,
        "addr_exact_norm": _both(addr, place),
        "addr_token_jaccard": set_jaccard(_words(addr), _words(place), 0.0),
        "addr_num_overlap": set_jaccard(digits(addr), digits(place), 0.5),
        "addr_num_jaccard": set_jaccard(digit_set(addr), digit_set(place), 0.5),
        "addr_postal_match": _both(text("s1_postal"), text("t_postal")),
        "addr_door_match": _both(text("s1_door"), text("t_door")),
        "country_agreement": flag(F.col("s1_country") == F.col("t_country")),
        "s1_name_missing": flag(name == ""), "t_name_missing": flag(other == ""), "s1_addr_missing": flag(addr == ""), "t_addr_missing": flag(place == ""),
        "candidate_rank": F.coalesce(F.try_divide(F.lit(1.0), rank), F.lit(0.0)),
        "blocking_pass_count": F.col("pass_count").cast("double"),
        "norm_rank": rank / max(k, 1),
        "score_margin": F.col("jaccard_score") - top,
        "top_score": top,
        "rank_x_jaccard": F.coalesce(F.try_divide(F.lit(1.0), rank), F.lit(0.0)) * F.col("jaccard_score"),
        "pass_count_norm": F.col("pass_count") / F.greatest(F.col("max_pass"), F.lit(1)),
    }


MEASURED = {
    "name_token_sort_ratio": ("token_sort", "norm_name"), "name_token_set_ratio": ("token_set", "norm_name"), "name_partial_ratio": ("partial", "norm_name"), "name_jaro_winkler": ("jaro_winkler", "norm_name"), "name_char_sim": ("ratio", "norm_name"),
    "addr_token_sort_ratio": ("token_sort", "norm_addr"), "addr_token_set_ratio": ("token_set", "norm_addr"), "addr_char_sim": ("ratio", "norm_addr"),
}
"""The features that need Arrow: measure and field."""
COMBINED = ("name_x_addr", "name_diff_addr", "composite_score", "name_addr_composite")
"""Those made of both token sort ratios."""


def arrow(names: tuple[str, ...] = tuple(MEASURED)) -> Column:
    """A struct of the measures that some features need, and of no others."""
    wanted = [n for n in MEASURED if n in names or n.endswith("token_sort_ratio") and any(c in names for c in COMBINED)]
    return measures(**{n: (MEASURED[n][0], F.col(f"s1_{MEASURED[n][1]}"), F.col(f"t_{MEASURED[n][1]}")) for n in wanted})


def with_max_pass(topk: DataFrame) -> DataFrame:
    """topk with the greatest pass count of all its pairs, from a broadcast single row, unless it has it."""
    return topk if "max_pass" in topk.columns else topk.crossJoin(F.broadcast(topk.agg(F.max("pass_count").alias("max_pass"))))


def _top(topk: DataFrame) -> Column | None:
    return F.col("top_score") if "top_score" in topk.columns else None


def builtin_features(topk: DataFrame, k: int = 25) -> DataFrame:
    """(s1_id, target_id) of a top-K list and the features that need no Arrow."""
    made = {f"f_{n}": c for n, c in builtin(k, _top(topk)).items()}
    return with_max_pass(topk).select("s1_id", "target_id", *[c.alias(n) for n, c in made.items()])


def features(topk: DataFrame, names: tuple[str, ...] = FEATURES_30, k: int = 25, keep: tuple[str, ...] = ()) -> DataFrame:
    """(s1_id, target_id, *keep, *names as f_*) of a top-K list; core names are compared if it has s1_core and t_core."""
    base = (with_max_pass(topk) if "pass_count_norm" in names else topk if "max_pass" in topk.columns else topk.withColumn("max_pass", F.lit(1))).withColumn("_m", arrow(names))
    sort, place = F.col("_m.name_token_sort_ratio"), F.col("_m.addr_token_sort_ratio")
    core = _both(F.col("s1_core"), F.col("t_core")) if "s1_core" in topk.columns else _both(F.col("s1_norm_name"), F.col("t_norm_name"))
    made = builtin(k, _top(topk)) | {n: F.col(f"_m.{n}") for n in MEASURED}
    made |= {"name_core_match": core, "name_x_addr": sort * place, "name_diff_addr": F.abs(sort - place), "composite_score": 0.65 * sort + 0.35 * place, "name_addr_composite": 0.7 * sort + 0.3 * place}
    return base.select("s1_id", "target_id", *keep, *[made[n].alias(f"f_{n}") for n in names])


def describe(matrix: DataFrame) -> DataFrame:
    """(feature, least, greatest, mean, deviation, nan, infinite, constant) of each f_* column."""
    names = [c for c in matrix.columns if c.startswith("f_")]
    long = matrix.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in names])).alias("x")).select("x.*")
    odd = F.isnan("v") | F.col("v").isNull()
    endless = F.abs("v") == float("inf")
    return long.groupBy("feature").agg(F.min("v").alias("least"), F.max("v").alias("greatest"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.count_if(odd).alias("nan"), F.count_if(endless).alias("infinite")).withColumn("constant", F.col("deviation") == 0)


def correlated(matrix: DataFrame, least: float = 0.98) -> DataFrame:
    """(a, b, r): pairs of f_* columns whose correlation exceeds `least`; one aggregation over the rows."""
    names = [c for c in matrix.columns if c.startswith("f_")]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    row = matrix.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*").filter(F.abs("r") > least)
