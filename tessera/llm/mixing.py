"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets the rate closest to 1 (in relative entropy, at most `max_rate`) for which the rates' tokens meet
its source's target. The solution of that problem is an exponential tilt, rate = min(max_rate, exp(lambda * x)) with x
the document's size over its source's mean size; lambda is the source's dual variable. The dual is convex and
separates by source, so one Newton step for all sources is one aggregation over a (source, size) histogram. Rates are
rounded to whole copies so that rounding errors cancel within small hash buckets of each source.

Edge cases: a null source is a source of its own, sorted last; a null or empty text has size 0 and takes nothing; a
source of size 0 has target 0; rows that agree in id, source and size get the same number of copies; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, documents, global_index, let, store

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_RATE = 2
BUCKET_ROWS = 500
TOLERANCE = 1e-12
DIGITS = 9
"""Decimals of a dual variable: sums in another order differ by less, so reruns agree."""
MAX_STEPS = 60


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """Add `target` to (source, source_size): `share` of all sizes split by weight, none above max_rate times its source.

    The weights repeat along the sources by code point, null last. Each round shares what is left among the sources
    that are not at their limit; it ends when none is above.
    """
    indexed = global_index(sources, "source", "_i")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    indexed = store(indexed.withColumn("_w", pick).withColumn("_cap", F.col("source_size") * float(max_rate)), "sources")
    total = indexed.agg(F.sum("source_size")).first()[0] or 0
    level, seen = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_cap") <= F.lit(level) * F.col("_w")
        n, capped, w = indexed.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if n == seen or not w:
            break
        seen, level = n, (share * total - (capped or 0.0)) / w
    level = F.lit(float(level or 0.0))
    return indexed.withColumn("target", F.least("_cap", level * F.col("_w"))).drop("_i", "_w", "_cap")


def _rate(max_rate: float) -> Column:
    """The tilted rate of a size under its source's dual variable."""
    top = F.log(F.lit(float(max_rate)))
    return F.when(F.col("full"), F.lit(float(max_rate))).otherwise(F.exp(F.least(top, F.col("lam") * F.col("size") / F.col("mean"))))


def solve(hist: DataFrame, sources: DataFrame, max_rate: float = MAX_RATE, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> DataFrame:
    """The dual variable `lam` of each source by safeguarded Newton steps, all sources at once.

    hist: (source, size, n) with size > 0; sources: (source, source_size, target). A step outside the bracket that the
    earlier steps left is replaced by its middle.
    """
    size = F.col("size").cast("double")
    moments = hist.groupBy("source").agg((F.sum(size * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(size * size * F.col("n")) / F.sum(size * F.col("n"))).alias("heavy"))
    state = moments.alias("m").join(sources.alias("s"), F.col("m.source").eqNullSafe(F.col("s.source"))).select(
        "s.source", "mean", "target",
        (F.col("target") >= F.col("source_size") * (max_rate - 1e-12)).alias("full"),
        (F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("heavy")).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
    )
    state = store(state, "dual")
    top = F.log(F.lit(float(max_rate)))
    for _ in range(max_steps):
        tilted = hist.alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select("s.*", "size", "n")
        words, rate, x = F.col("size") * F.col("n"), _rate(max_rate), F.col("size") / F.col("mean")
        sums = tilted.groupBy("source", "mean", "target", "full", "lam", "lo", "hi").agg(F.sum(words * rate).alias("g"), F.sum(F.when(F.col("lam") * x < top, words * x * rate).otherwise(0.0)).alias("slope"))
        off = F.col("g") - F.col("target")
        done = F.col("full") | (F.abs(off) <= tolerance * F.col("target"))
        sums = sums.select("source", "mean", "target", "full", "lam", "slope", off.alias("off"), done.alias("done"), F.when(off < 0, F.col("lam")).otherwise(F.col("lo")).alias("lo"), F.when(off > 0, F.col("lam")).otherwise(F.col("hi")).alias("hi"))
        step = F.col("lam") - F.try_divide("off", "slope")
        middle = (F.when(F.col("lo").isNull(), F.col("hi") - 1 - F.abs("hi")).when(F.col("hi").isNull(), F.col("lo") + 1 + F.abs("lo")).otherwise((F.col("lo") + F.col("hi")) / 2))
        inside = step.isNotNull() & (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi"))) & (F.abs(step - F.col("lam")) <= 8 + F.abs("lam"))
        state = store(sums.select("source", "mean", "target", "full", "done", F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise(middle).alias("lam"), "lo", "hi"), "dual")
        if not state.filter(~F.col("done")).limit(1).count():
            break
        state = state.drop("done")
    return state.select("source", "mean", "full", F.round("lam", DIGITS).alias("lam"))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies), one row for all rows of sized that agree in the first three.

    sized: (doc_id, source, size). Copies are whole and lie between 0 and max_rate. Within a bucket documents are
    rounded from the largest to the smallest, each so that the words taken so far come closest to those its rates ask for.
    """
    items = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    hist = store(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = store(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows")), weights, share, max_rate), "targets")
    dual = solve(hist.filter("size > 0"), sources, max_rate)
    sources = store(sources.alias("s").join(dual.alias("d"), F.col("s.source").eqNullSafe(F.col("d.source")), "left").select("s.*", "mean", "full", "lam"), "solved")
    joined = items.alias("i").join(sources.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source"))).select("i.*", "source_size", "source_rows", "target", "mean", "full", "lam")
    rated = joined.withColumn("rate", F.coalesce(F.when(F.col("size") > 0, _rate(max_rate)), F.lit(0.0)))
    draw = F.xxhash64("doc_id", "size")
    rated = rated.withColumn("bucket", F.pmod(draw, F.ceil(F.col("source_rows") / BUCKET_ROWS)))
    item = F.struct((-F.col("size") * F.col("m")).alias("order"), draw.alias("draw"), "doc_id", "size", "m", "rate", "target", "source_size")
    grouped = rated.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def take(acc, x):
        words = (x["size"] * x["m"]).cast("double")
        due = acc["due"] + words * (x["rate"] - F.floor(x["rate"]))
        extra = F.when((words > 0) & (due * 2 >= words) & (x["rate"] > F.floor(x["rate"])), F.lit(1)).otherwise(F.lit(0))
        n = (F.floor(x["rate"]) + extra).cast("int")
        return F.struct((due - extra * words).alias("due"), F.concat(acc["taken"], F.array(n)).alias("taken"))

    start = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<int>").alias("taken"))
    rounded = grouped.select("source", let(F.aggregate("items", start, take)["taken"], lambda taken: F.zip_with("items", taken, lambda x, n: F.struct(x.alias("x"), n.alias("copies")))).alias("items"))
    rounded = rounded.select("source", F.explode("items").alias("i")).select("source", "i.x.*", "i.copies")
    return rounded.select("doc_id", "source", "size", "source_size", "target", "rate", "copies")


def _with_plan(docs: DataFrame, planned: DataFrame, doc_id: str, source: str, size: Column, columns: list[Column]) -> DataFrame:
    """docs with columns of their plan, which has about as many rows: they are sorted and merged at every size."""
    same = F.col(f"d.{doc_id}").eqNullSafe(F.col("r.doc_id")) & F.col(f"d.{source}").eqNullSafe(F.col("r.source")) & (size == F.col("r.size"))
    return docs.alias("d").join(planned.alias("r").hint("merge"), same).select("d.*", *columns)


def copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies), one row for each row of docs.

    docs is read as (doc_id, source, size); its other columns, whatever their names, play no part.
    """
    sized = store(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")), "sized")
    planned = plan(sized, weights, share, max_rate)
    return _with_plan(sized, planned, "doc_id", "source", F.col("d.size"), [F.col(f"r.{c}") for c in ("source_size", "target", "rate", "copies")])


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """docs with each row as often as the mix takes it; sizes are word counts of its text."""
    size = word_count(F.col(text))
    sized = store(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")), "sized")
    planned = store(plan(sized, weights, share, max_rate).filter("copies > 0").select("doc_id", "source", "size", "copies"), "planned")
    repeated = _with_plan(docs, planned, doc_id, source, word_count(F.col(f"d.{text}")), [F.explode(F.sequence(F.lit(1), F.col("r.copies"))).alias("_copy")])
    return repeated.select(*[repeated[c] for c in docs.columns])


def op2_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count("text").alias("size"))
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
