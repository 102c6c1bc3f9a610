"""Quality rules whose thresholds adapt to each language and source.

Per text, Python counts a few things (count_features); the rates made of them, in thousandths, go into mergeable
quantile sketches: histograms with 128 log-spaced bins an octave, counted by (language, source, rate, bin). Sketches
add up: those of a language are its groups' sum, the corpus's is the sum of all.

No threshold is fixed. A rate may lie FENCE spreads above its group's median (word length also below it). Medians of
few texts lean on the language's, as if PRIOR texts of it were added, and the language's on the corpus's. A spread is
the distance from the median to the quartile, the least of the group's, its language's and the corpus's, so that a
group of which a large part is junk doesn't widen its own fence; nor is it less than what GRAIN counts make in a short
text (the lower quartile of words, lines or letters), as most rates are 0 in most texts. Fixed rules (base_failed)
reject as well.

Edge cases: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; rows that repeat count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import discard, documents, store, tidy

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 12
"""Spreads from a group's median to its threshold."""
PRIOR = 50
"""Texts of its language that are added to a group's, and of the corpus to a language's."""
RATES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_letters"), "word_length": ("word_chars", "n_words")}
GRAIN = {"symbols": 1, "dup_lines": 1, "repeats": 6, "upper": 4, "word_length": 10}
"""For each rate, the counts that one occurrence makes."""
LOWER = ("word_length",)
"""Rates with a lower threshold too."""
SIZES = ("n_words", "n_lines", "n_letters")
EXACT = 256
"""Numbers below have bins of their own; above, as many bins an octave as half of it."""

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = ids[:-2] * len(seen) + ids[1:-1]
    if len(seen) < 2_000_000:
        key = pair * len(seen) + ids[2:]
    else:
        key = np.unique(pair, return_inverse=True)[1] * len(seen) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return 0
    at = np.concatenate([order[same], order[same + 1]])
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[at + i] = True
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, dup, seen = 0, 0, set()
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines,
        len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, LETTERS)),
    )


def _count(batches: Iterator[pa.RecordBatch], text: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in tidy(batches):
        found = np.array([counts(t.as_py()) for t in b.column(text)], np.int64).reshape(-1, len(COUNTS))
        kept = [i for i in range(b.num_columns) if with_text or i != text]
        yield pa.record_batch([*(b.column(i) for i in kept), *(pa.array(c) for c in found.T)], names=[*(b.schema.names[i] for i in kept), *COUNTS])


def count_features(docs: DataFrame, keep: list[str], text: str = "text", with_text: bool = False) -> DataFrame:
    """The columns `keep` of docs, with its text if asked for, and COUNTS of its text."""
    docs = docs.select(*keep, text)
    fields = T.StructType([f for f in docs.schema.fields if with_text or f is not docs.schema.fields[-1]] + [T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.mapInArrow(lambda it: _count(it, len(keep), with_text), fields)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The rates in thousandths, as whole numbers; 0 where they aren't defined."""
    return {k: F.coalesce(F.expr(f"try_divide(1000 * {a}, {b})"), F.lit(0.0)).cast("long") for k, (a, b) in RATES.items()}


def bin_of(v: Column) -> Column:
    """The sketch's bin of a whole number >= 0: itself below EXACT, then EXACT / 2 bins an octave."""
    half, low = EXACT // 2, EXACT.bit_length() - 1
    octave = F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))).cast("int")
    return F.when(v < EXACT, v).otherwise(half * (octave - low + 1) + F.floor(v / F.pow(F.lit(2.0), octave - low + 1)).cast("long")).cast("long")


def value_of(b: Column) -> Column:
    """The least number in a bin."""
    half = EXACT // 2
    shift = F.floor((b - EXACT) / half) + 1
    return F.when(b < EXACT, b).otherwise((F.pmod(b - EXACT, F.lit(half)) + half) * F.pow(F.lit(2.0), shift)).cast("long")


def sketch(features: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n) of the texts that pass the base rules. Sketches merge by adding n."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), bin_of(v).alias("bin")) for k, v in (rates() | {k: F.col(k) for k in SIZES}).items()])
    rows = features.filter(~base_failed()).select("lang", "source", F.explode(pairs).alias("p"))
    return rows.groupBy("lang", "source", "p.rate", "p.bin").agg(F.count("*").alias("n"))


def thresholds(sketches: DataFrame, fence: int = FENCE, prior: int = PRIOR) -> DataFrame:
    """(lang, source, low_<rate>, high_<rate>): the thresholds of each group."""
    parts = ("low", "mid", "up", "down")

    def quartiles(keys: list[str]) -> DataFrame:
        """By keys and rate: lower quartile, median, and the distances from it to both quartiles."""
        w = Window.partitionBy(*keys, "rate")
        s = sketches.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
        s = s.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("texts", F.sum("n").over(w))
        at = lambda q: value_of(F.min(F.when(F.col("upto") >= F.ceil(F.col("texts") * q), F.col("bin"))))
        q = s.groupBy(*keys, "rate", "texts").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
        return q.select(*keys, "rate", "texts", "low", "mid", (F.col("high") - F.col("mid")).alias("up"), (F.col("mid") - F.col("low")).alias("down"))

    def lean(a: str, b: str) -> list[Column]:
        """The values of a, as if `prior` texts with the values of b were among its own."""
        return [((F.col(f"{a}.{c}") * F.col(f"{a}.texts") + prior * F.col(f"{b}.{c}")) / (F.col(f"{a}.texts") + prior)).alias(c) for c in parts]

    every, lang, own = quartiles([]).alias("e"), quartiles(["lang"]).alias("l"), quartiles(["lang", "source"]).alias("o")
    least = lambda c, d: F.least(F.col(c), F.col(d))
    lang = lang.join(F.broadcast(every), F.col("l.rate") == F.col("e.rate")).select("l.lang", "l.rate", *lean("l", "e"), F.col("e.up").alias("every_up"), F.col("e.down").alias("every_down"))
    lang = lang.withColumn("most_up", least("up", "every_up")).withColumn("most_down", least("down", "every_down")).alias("l")
    own = own.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.rate") == F.col("l.rate"))).select("o.lang", "o.source", "o.rate", *lean("o", "l"), "most_up", "most_down")
    own = own.withColumn("up", least("up", "most_up")).withColumn("down", least("down", "most_down"))
    wide = own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == k, F.col(c))).alias(f"{c}_{k}") for k in (*RATES, *SIZES) for c in parts])

    def spread(k: str, side: str) -> Column:
        return F.greatest(F.lit(1000.0 * GRAIN[k]) / F.greatest(F.col(f"low_{RATES[k][1]}"), F.lit(1.0)), F.col(f"{side}_{k}"))

    high = [(F.col(f"mid_{k}") + fence * spread(k, "up")).alias(f"high_{k}") for k in RATES]
    low = [(F.col(f"mid_{k}") - fence * spread(k, "down")).alias(f"low_{k}") for k in LOWER]
    return wide.select("lang", "source", *low, *high)


def _judged(features: DataFrame, limits: DataFrame) -> DataFrame:
    """features with base_failed and kept."""
    ok = F.lit(True)
    for k, v in rates().items():
        if k in LOWER:
            ok &= F.coalesce(v >= F.col(f"low_{k}"), F.lit(True))
        ok &= F.coalesce(v <= F.col(f"high_{k}"), F.lit(True))
    f, t = features.alias("f"), limits.alias("t")
    joined = f.join(t, F.col("f.lang").eqNullSafe(F.col("t.lang")) & F.col("f.source").eqNullSafe(F.col("t.source")), "left")
    return joined.select("f.*", base_failed().alias("base_failed"), (~base_failed() & ok).alias("kept"))


def judge(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The columns `keep` of docs with COUNTS, base_failed and kept."""
    named = docs.select(F.struct(*keep).alias("_keep"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    features = store(count_features(named, ["_keep", "lang", "source"]), "features")
    sketches = store(sketch(features), "sketches")
    limits = store(thresholds(sketches), "thresholds")
    discard(sketches)
    return _judged(features, limits).select("_keep.*", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that are kept. Texts are counted twice, for the sketches and for the verdict, and not stored."""
    rest = [c for c in docs.columns if c != text]
    named = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_keep"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("_text"))
    sketches = store(sketch(count_features(named, ["lang", "source"], "_text")), "sketches")
    limits = store(thresholds(sketches), "thresholds")
    discard(sketches)
    good = _judged(count_features(named, ["_keep", "lang", "source"], "_text", True), limits).filter("kept")
    return good.select(*[F.col("_text").alias(c) if c == text else F.col("_keep")[c].alias(c) for c in docs.columns])


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), ["doc_id"]).select("doc_id", *COUNTS[:5], "base_failed", "kept")
