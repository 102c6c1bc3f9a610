"""Whole runs: training with validation, and inference, each as lazy plans with no chunks and no loop over countries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocking, blocks, evaluate, features, links, models, ranking, retrieval
from tessera.operators.keys import prepare
from tessera.sources.scratch import stored
from tessera.sources.tables import matches

ADDRESS_PASSES = ("F1", "F2", "F3")


@dataclass
class Trained:
    models: dict[str, PipelineModel]
    grids: dict[str, DataFrame]
    winner: str
    threshold: float
    names: tuple[str, ...]


def strategy_lists(sources: DataFrame, targets: DataFrame, names: tuple[str, ...], k: int | None = None) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """Of each compared or plain strategy, the lists of blocks.best() and the passes whose classes have them.

    Strategies of the same passes share lists, as deep as the deepest needs. E and F add n-gram candidates, and F those of address keys.
    """
    plan = {n: (*blocking.DEPTHS.get(n, (n, 25)), ADDRESS_PASSES if n == "F" else ()) for n in names}
    plan = {n: (passes, k or depth, more) for n, (passes, depth, more) in plan.items()}
    made = {}
    for passes, more in {(p, m) for p, _, m in plan.values()}:
        deepest = max(depth for p, depth, m in plan.values() if (p, m) == (passes, more))
        made[passes, more] = blocks.best(sources, targets, passes, deepest, more=more)
    found = None
    out = {}
    for n, (passes, depth, more) in plan.items():
        every = (*blocking.STRATEGIES[passes], *more)
        lists = made[passes, more].filter(F.col("candidate_rank") <= depth)
        if n in ("E", "F"):
            if found is None:
                found, _ = stored(retrieval.ngram_lists(sources, targets).select(F.col("_class").alias("_text"), "target_id"), "ngrams")
            lists = blocks.extended(lists, found, sources, targets, every, "norm_name", depth)
        out[n] = lists, every
    return out


def strategy_topk(sources: DataFrame, targets: DataFrame, name: str, extra: tuple[str, ...] = (), k: int | None = None) -> DataFrame:
    """The list of a compared strategy, or a plain one."""
    lists, every = strategy_lists(sources, targets, (name,), k)[name]
    return blocks.top_k(sources, targets, every, extra=extra, lists=lists)


def compare_strategies(sources: DataFrame, targets: DataFrame, truth: DataFrame, names: tuple[str, ...] = ("A", "B", "C", "D", "E", "F"), same: str | None = None) -> DataFrame:
    """(strategy, rows, entities, value (95th percentile of candidates), links, hits and recall at 10, 25, 50).

    truth: (s1_id, target_id). With `same`, a column of both sides, links are the pairs of a country that agree in it, and truth is one row with their number.
    """
    rows = []
    for n, (lists, every) in strategy_lists(sources, targets, names).items():
        if same is None:
            topk = lists.join(sources.select(blocks.class_of(every).alias("_class"), F.col("entity_id").alias("s1_id")), "_class")
            rows.append((n, evaluate.nearest_rank(topk).crossJoin(evaluate.recall_at(topk, truth))))
        else:
            s = sources.filter("entity_id is not null").select(blocks.class_of(every).alias("_class"), F.col(same).alias("same"))
            rows.append((n, evaluate.of_classes(lists, s, targets.select(F.col("entity_id").alias("target_id"), F.col(same).alias("same")), truth)))
    return evaluate.compare(rows)


def split_sources(sources: DataFrame, truth: DataFrame, validation: float = 0.2) -> DataFrame:
    """Prepared sources with their truth and split."""
    return ranking.split(links.with_truth(prepare(sources), truth), validation=validation)


def train(sources: DataFrame, targets: DataFrame, truth: DataFrame, k: int = 25, ratio: float = 3.0, names: tuple[str, ...] = features.FEATURES_24, distractors: int = 150_000, strategy: str = "8", blends: tuple[float, ...] = (), rounds: int = 40) -> Trained:
    """Fit a linear and a boosted model on positives and the hardest negatives; the best macro F0.5 on validation wins."""
    known = links.explode_links(truth)
    s = split_sources(sources, truth).persist()
    pool = links.target_pool(prepare(targets), known, distractors)
    topk = strategy_topk(s, pool, strategy, ("split",), k)
    labelled = links.label(topk, known).persist()
    training = labelled.filter("split = 'train'")
    chosen = links.balanced(training, links.hardest_negatives(training, ratio))
    fitted = features.features(chosen, names, k, ("label",)).persist()
    held = features.features(labelled.filter("split = 'val'"), names, k, ("label",)).persist()
    validating = s.filter("split = 'val'").select(F.col("entity_id").alias("s1_id"))
    of_validation = known.join(validating, "s1_id", "left_semi")
    found = {"logistic": models.logistic(fitted), "boosted": models.boosted(fitted, rounds)}
    scored = {n: models.predict(m, held) for n, m in found.items()}
    for a in blends:
        scored[f"blend_{a:g}"] = models.blend(scored["logistic"], scored["boosted"], a)
    grids = {n: evaluate.threshold_grid(p, of_validation, validating) for n, p in scored.items()}
    best = {n: evaluate.best_threshold(g) for n, g in grids.items()}
    name = models.winner({n: f for n, (_, f) in best.items()}, "boosted")
    return Trained(found, grids, name, best[name][0], names)


def infer(sources: DataFrame, targets: DataFrame, model: PipelineModel, threshold: float, k: int = 25, names: tuple[str, ...] = features.FEATURES_24, strategy: str = "8") -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) of every source as comma lists."""
    s, t = prepare(sources), prepare(targets)
    topk = strategy_topk(s, t, strategy, k=k)
    scored = models.predict(model, features.features(topk, names, k, ("candidate_rank",)))
    return matches(sources, scored.filter(F.col("probability") >= threshold)), matches(sources, topk, out="candidate_entity_ids")
