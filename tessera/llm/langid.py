"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A letter trigram (words are joined by one
blank, which has a vector too) is bound as the product of its letters' vectors, each permuted by its place; a text
bundles the vectors of all its trigrams. A language's prototype is the sum of its training texts' unit vectors; the
prediction is the prototype with the largest cosine.

Letters are what Unicode calls alphabetic, in lower case. Everything else is white space to this operator. Texts are
read whole; long ones in pieces that share two letters, which gives the same vector to the bit. Training sums are whole
numbers, so reruns agree to the bit.

Edge cases: `und` and score 0 for a null text, a text without letters, or where there is nothing to learn from; rows
with a null text or language teach nothing; ties go to the first language by code point; repeated rows count as often
as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import documents, store, tidy

DIMENSIONS = 512
SEED = 20240229
UNIT = 1 << 20
PIECE_CHARS = 1 << 20
"""Characters of one text handled at once."""
GROUP_CHARS = 2 << 20
"""Characters of several texts handled at once."""
BLOCK_LANGUAGES = 1024
"""Prototypes sent to the executors at once; more languages take more passes."""

BLANK = 32
_class = np.full(0x110000, -1, np.int32)
_vectors: dict[int, np.ndarray] = {}


def _classes(points: np.ndarray) -> np.ndarray:
    """The lower-case letter of each code point, or BLANK."""
    out = _class[points]
    if (out < 0).any():
        for p in np.unique(points[out < 0]).tolist():
            c = chr(p)
            low = c.lower()
            _class[p] = ord(low[0]) if c.isalpha() else BLANK
        out = _class[points]
    return out


def _letters(found: np.ndarray, dimensions: int) -> np.ndarray:
    for p in found.tolist():
        if p not in _vectors or len(_vectors[p]) != dimensions:
            bits = np.random.Generator(np.random.PCG64([SEED, p])).integers(0, 2, dimensions, dtype=np.int8)
            _vectors[p] = 2 * bits - 1
    return np.stack([_vectors[p] for p in found.tolist()])


def _spelt(text: str) -> Iterator[np.ndarray]:
    """A text's letters, with one blank between, before and after words, in pieces; each begins with the last two of the one before."""
    tail = np.array([BLANK], np.int32)
    for at in range(0, max(1, len(text)), PIECE_CHARS):
        points = np.frombuffer(text[at : at + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        end = [np.array([BLANK], np.int32)] if at + PIECE_CHARS >= len(text) else []
        kinds = np.concatenate([tail, _classes(points), *end])
        blank = kinds == BLANK
        kinds = kinds[np.r_[True, ~(blank[1:] & blank[:-1])]]
        yield kinds
        tail = kinds[-2:]


def _bundle(pieces: list[np.ndarray], dimensions: int) -> np.ndarray:
    """The bundled trigram vectors of pieces, one row each; all zero without letters."""
    kinds = np.concatenate(pieces)
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    out = np.zeros((len(pieces), dimensions), np.float32)
    if len(kinds) < 3:
        return out
    present = np.flatnonzero(np.bincount(kinds))
    dense = np.zeros(present[-1] + 1, np.int64)
    dense[present] = np.arange(len(present))
    n, ids = len(present), dense[kinds]
    inside = owner[2:] == owner[:-2]
    key, who = ((ids[:-2] * n + ids[1:-1]) * n + ids[2:])[inside], owner[2:][inside]
    if n**3 <= 1 << 22:
        grams = np.flatnonzero(np.bincount(key, minlength=n**3))
        place = np.zeros(n**3, np.int64)
        place[grams] = np.arange(len(grams))
        place = place[key]
    else:
        grams, place = np.unique(key, return_inverse=True)
    letters = _letters(present, dimensions)
    first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
    for low in range(0, len(grams), 8192):
        part = grams[low : low + 8192]
        bound = (first[part // (n * n)] * second[part // n % n] * letters[part % n]).astype(np.float32)
        mine = (place >= low) & (place < low + 8192) if len(grams) > 8192 else slice(None)
        counts = np.bincount(who[mine] * len(part) + place[mine] - low, minlength=len(pieces) * len(part))
        out += counts.reshape(len(pieces), len(part)).astype(np.float32) @ bound
    return out


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> Iterator[np.ndarray]:
    """The unit vectors of texts, in groups; all zero for a text without letters."""
    group: list[np.ndarray] = []
    chars = 0

    def unit(v: np.ndarray) -> np.ndarray:
        size = np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
        return v / np.where(size > 0, size, 1)

    for t in texts:
        t = t or ""
        if len(t) > PIECE_CHARS:
            if group:
                yield unit(_bundle(group, dimensions))
                group, chars = [], 0
            # Sums of a piece are whole and below 2 ** 24, so exact; so is their total.
            total = np.zeros((1, dimensions))
            for piece in _spelt(t):
                total += _bundle([piece], dimensions)
            yield unit(total)
            continue
        group += _spelt(t)
        chars += len(t)
        if chars >= GROUP_CHARS or len(group) >= 512:
            yield unit(_bundle(group, dimensions))
            group, chars = [], 0
    if group:
        yield unit(_bundle(group, dimensions))


def _all_vectors(texts: list[str | None], dimensions: int) -> np.ndarray:
    return np.concatenate([*text_vectors(texts, dimensions), np.zeros((0, dimensions))])


def _learn(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in tidy(batches):
        langs, vectors = b.column(0).to_pylist(), _all_vectors(b.column(1).to_pylist(), dimensions)
        whole = np.rint(vectors * UNIT).astype(np.int64)
        for lang in set(langs):
            mine = whole[[x == lang for x in langs]]
            sums[lang] = sums.get(lang, 0) + mine.sum(0)
    names = sorted(sums)
    yield pa.record_batch([pa.array(names, pa.string()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.int64()))], names=["lang", "vector"])


def prototypes(training: DataFrame, dimensions: int = DIMENSIONS, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, vector): the sum of the unit vectors of each language's texts, in units of 1 / UNIT.

    Each task sums what it reads; sums meet by (language, dimension), so a language that holds most rows isn't slower.
    """
    rows = training.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    partial = rows.mapInArrow(lambda it: _learn(it, dimensions), "lang string, vector array<long>")
    summed = partial.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def _predict(batches: Iterator[pa.RecordBatch], names: list[str], matrix: np.ndarray, text: int, first: bool, keep_text: bool, dimensions: int) -> Iterator[pa.RecordBatch]:
    for b in tidy(batches):
        old = b.schema.names
        vectors = _all_vectors(b.column(text).to_pylist(), dimensions)
        cosine = np.round(vectors @ matrix.T, 12)
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        langs = [names[i] if v.any() else "und" for i, v in zip(best.tolist(), vectors, strict=True)]
        score = np.where(vectors.any(1), score, 0.0)
        if not first:
            was = np.array(b.column(len(old) - 1).to_pylist())
            earlier = b.column(len(old) - 2).to_pylist()
            langs = [new if s > w else e for new, e, s, w in zip(langs, earlier, score, was, strict=True)]
            score = np.maximum(score, was)
        kept = [i for i in range(len(old) if first else len(old) - 2) if keep_text or i != text]
        yield pa.record_batch([*(b.column(i) for i in kept), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*(old[i] for i in kept), "lang_pred", "score"])


def predict(docs: DataFrame, learned: DataFrame, dimensions: int = DIMENSIONS, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with `lang_pred` and `score`, without its text unless keep_text; columns of docs by these names are replaced.

    learned: what prototypes() returns. At most BLOCK_LANGUAGES prototypes reach the executors at once; a pass keeps
    the better of its own and the earlier passes' languages.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    learned = store(learned, "prototypes")
    n, last = learned.count(), None
    if not n:
        return (docs if keep_text else docs.drop(text)).withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    out, place = docs, docs.columns.index(text)
    for low in range(0, n, BLOCK_LANGUAGES):
        first, keep = not low, keep_text or low + BLOCK_LANGUAGES < n
        block = learned if last is None else learned.filter(F.col("lang") > last)
        rows = block.orderBy("lang").limit(BLOCK_LANGUAGES).collect()
        names, last = [r["lang"] for r in rows], rows[-1]["lang"]
        matrix = np.array([r["vector"] for r in rows], np.float64)
        size = np.sqrt((matrix**2).sum(1, keepdims=True))
        sent = spark.sparkContext.broadcast((names, matrix / np.where(size > 0, size, 1)))
        fields = [f for f in docs.schema.fields if keep or f.name != text]
        schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
        out = out.mapInArrow(lambda it, sent=sent, first=first, keep=keep: _predict(it, *sent.value, place, first, keep, dimensions), schema)
    return out


def held_out(doc_id: str | Column = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op3_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = prototypes(docs.filter(~held_out()).select("lang", "text"))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), learned, keep_text=False)
