"""A language model from a probabilistic suffix tree, and the scoring of texts under it.

A text is read as its words (ASCII letters in lower case) joined by one blank, byte by byte, with an end symbol. All
windows of DEPTH context bytes and the next byte are counted over the training texts; windows of texts that are only
scored count 0. A context is a candidate if it stands MIN_COUNT times at least, in a corpus of any size; it is retained
if its next-byte distribution diverges from that of its suffix one byte shorter (their Kullback-Leibler divergence,
weighted by the context's count, exceeds GAIN nats for each different next byte), or if a longer retained context ends
in it. Distributions are smoothed towards the suffix's with the Witten-Bell weight. A byte is scored in the state of
the longest retained suffix of what comes before it.

The tree grows with the corpus and is a table: levels are aggregated, smoothed, tested and looked up by shuffles of
different windows, which ends in the probability of each. Texts are read twice, once to count and once to score,
whatever the tree's size: the windows that stand most often, SENT_WINDOWS at most, are sent to the executors, and a
text's others are joined. So it is with words for the unigram base score: those with at least HEAVY_SHARE of all
tokens (at most 1 / HEAVY_SHARE) are sent, and rarer ones are joined by hash.

Words are told apart by 64-bit hashes. Counts are sums of whole numbers, what is joined is summed in whole units of
1 / UNIT, and the rest is computed in a fixed order, so reruns agree.

Edge cases: a null or empty text is the end symbol alone; with nothing to learn from, all bytes are equally likely;
texts that repeat count as often; a null doc_id counts as not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, documents, store

DEPTH = 6
MIN_COUNT = 2
GAIN = 1.0
HEAVY_SHARE = 1e-6
ADD = 0.1
END = 255
"""The end symbol, and what comes before a text; no UTF-8 text has this byte."""
SYMBOLS = 257
SENT_WINDOWS = 1 << 21
"""Windows whose probabilities are sent, at most; 12 bytes each."""
FETCH = 1 << 19
"""How many of them the driver takes at once, about."""
UNIT = 1 << 30
FLUSH = 1 << 21
"""Windows or words a task gathers, at least, before it merges them with those it has."""
HOLD = 3 << 20
"""Different ones it holds before it passes them on."""
SHORT = 32
"""Bytes of a word up to which words are hashed together."""
SLICE = 1 << 8
"""Texts handled at once; a text's place among them is one byte."""


def _mix(x: np.ndarray) -> np.ndarray:
    """Another number for each 64-bit number, all bits of which depend on all of its own (the end of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(words: pa.Array) -> np.ndarray:
    """64-bit hashes: eight bytes of all words at a time; words longer than SHORT one by one."""
    import xxhash

    if not len(words):
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_string()).cast(pa.large_binary())
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    padded = np.zeros(edges[-1] + 8, np.uint8)
    if edges[-1]:
        padded[:-8] = np.frombuffer(words.buffers()[2], np.uint8)[: edges[-1]]
    eight = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    starts, sizes = edges[:-1], np.diff(edges)
    out = _mix(sizes.astype(np.uint64))
    for at in range(0, SHORT, 8):
        here = np.flatnonzero((sizes > at) & (sizes <= SHORT))
        cut = 8 * np.maximum(0, at + 8 - sizes[here]).astype(np.uint64)
        out[here] = _mix(out[here] ^ (eight[starts[here] + at] << cut))
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = xxhash.xxh64_intdigest(words[i].as_py())
    return out.view(np.int64)


@dataclass
class Batch:
    """Texts as Arrow reads them. tokens: their words, in lower case, text by text; owner: the text of each word."""

    tokens: pa.Array
    owner: np.ndarray
    bounds: np.ndarray
    raw: np.ndarray
    scored: np.ndarray
    starts: np.ndarray

    @classmethod
    def read(cls, texts: pa.Array, depth: int = DEPTH) -> Batch:
        """raw: the texts' bytes, each text after `depth` end symbols and before one; scored: all but those before; starts: where texts begin."""
        texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
        split = pc.ascii_split_whitespace(texts)
        tokens, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
        filled = pc.greater(pc.binary_length(tokens), 0)
        if not pc.all(filled, min_count=0).as_py():
            tokens, owner = tokens.filter(filled), owner[filled.to_numpy(zero_copy_only=False)]
        joined = pc.binary_join(split, pa.scalar(" ", pa.large_string()))
        sizes = pc.binary_length(joined).to_numpy(zero_copy_only=False)
        starts = np.cumsum(np.r_[0, sizes + depth + 1])
        raw = np.full(starts[-1], END, np.uint8)
        scored = np.ones(len(raw), bool)
        for i in range(depth):
            scored[starts[:-1] + i] = False
        bytes_ = scored.copy()
        bytes_[starts[1:] - 1] = False
        buffer, first = joined.buffers()[2], joined.buffers()[1]
        edges = np.frombuffer(first, np.int64)[joined.offset : joined.offset + len(joined) + 1]
        if buffer is not None:
            raw[bytes_] = np.frombuffer(buffer, np.uint8)[edges[0] : edges[-1]]
        return cls(tokens, owner, np.searchsorted(owner, np.arange(len(texts) + 1)), raw, scored, starts[:-1])


def windows(batch: Batch, depth: int = DEPTH) -> np.ndarray:
    """A number for each scored byte: the bytes before it, the last first, then the byte."""
    n = len(batch.raw) - depth
    padded = np.r_[batch.raw, np.zeros(8, np.uint8)]
    # The eight bytes from each place on as a little-endian number: what comes last in a context weighs most.
    eight = np.ndarray(n, "<i8", padded.data, strides=(1,))
    key = eight & ((1 << (8 * depth)) - 1)
    key <<= 8
    key |= batch.raw[depth:]
    return key[batch.scored[depth:]]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut small, none of them empty. They are copied: Arrow's string functions go wrong on slices that are cast."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.take(pa.array(np.arange(at, min(b.num_rows, at + SLICE))))


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and their lengths."""
    begins = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=begins[1:])
    first = np.flatnonzero(begins)
    return first, np.diff(first, append=len(ordered))


class _Counter:
    """Counts of numbers. What was added last is merged with the rest once it is as much."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.loose: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: ascending and different."""
        self.loose.append((keys, counts))
        self.n += len(keys)
        if self.n >= max(FLUSH, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.counts), *self.loose]
        self.keys = self.counts = self.loose = None
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = np.concatenate([c for _, c in parts])[order]
        del parts, order
        first, _ = _runs(keys)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.loose, self.n = [], 0

    def drain(self, least: int) -> tuple[np.ndarray, np.ndarray] | None:
        if len(self.keys) + self.n <= least:
            return None
        self.merge()
        out = self.keys, self.counts
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    counters = (_Counter(), _Counter())
    loose: tuple[list[np.ndarray], ...] = ([], [])
    held = 0

    def rows(least: int) -> Iterator[pa.RecordBatch]:
        for kind, c in enumerate(counters):
            if out := c.drain(least):
                for at in range(0, len(out[0]), 1 << 16):
                    k, n = (x[at : at + (1 << 16)] for x in out)
                    yield pa.record_batch([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n)], names=["kind", "key", "n"])

    def settle() -> None:
        nonlocal held
        for weight, found in enumerate(loose):
            if found:
                keys = np.concatenate(found)
                found.clear()
                keys.sort()
                first, times = _runs(keys)
                counters[1].add(keys[first], times * weight)
        held = 0

    for b in slices(batches):
        for weight, rows_of in enumerate((pc.invert(b.column(1)), b.column(1))):
            texts = b.column(0).filter(rows_of)
            if not len(texts):
                continue
            batch = Batch.read(texts, depth)
            if weight:
                times = batch.tokens.value_counts()
                keys = np.r_[_hash(times.field(0)), _hash(pa.array([""]))]
                order = np.argsort(keys)
                counters[0].add(keys[order], np.r_[times.field(1).to_numpy(), len(texts)][order])
            loose[weight].append(windows(batch, depth))
            held += len(loose[weight][-1])
        if held >= FLUSH:
            settle()
        yield from rows(HOLD)
        pa.default_memory_pool().release_unused()
    settle()
    yield from rows(0)


def count_corpus(docs: DataFrame, text: str = "text", depth: int = DEPTH, training: Column | None = None) -> DataFrame:
    """(kind, key, n): counts of words (kind 0, by hash; the end token is the empty word) and of windows (kind 1).

    Only texts where `training` holds count (None: all). Windows that only the others have get rows too, with n 0.
    """
    learns = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    partial = docs.select(text, learns.alias("_learns")).mapInArrow(lambda it: _count(it, depth), "kind byte, key long, n long")
    return store(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def _shorter(key: Column) -> Column:
    """The key of the same next byte after the context without its earliest byte."""
    return F.shiftleft(F.shiftright(key, 16), 8).bitwiseOR(key.bitwiseAND(F.lit(255)))


def _level(counts: DataFrame, before: DataFrame, min_count: int, gain: float) -> DataFrame:
    """(key, n, p, own) of `counts`, whose suffixes' are in `before`; p: null where the context is no candidate; own: the divergence test.

    A suffix, the contexts one byte longer and their next bytes, at most 256 * 257 rows, meet in one task; so one
    shuffle serves the smoothing and the test.
    """
    byte = F.col("key").bitwiseAND(F.lit(255)).alias("byte")
    none = F.lit(None)
    longer = counts.select(F.shiftright("key", 16).alias("suffix"), F.shiftright("key", 8).alias("context"), byte, "n", none.cast("double").alias("p"))
    shorter = before.select(F.shiftright("key", 8).alias("suffix"), none.cast("long").alias("context"), byte, none.cast("long").alias("n"), "p")
    own = Window.partitionBy("suffix", "context").orderBy("byte").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = longer.unionByName(shorter).repartition("suffix")
    rows = rows.withColumn("before", F.max("p").over(Window.partitionBy("suffix", "byte"))).filter("context is not null")
    rows = rows.withColumn("all", F.sum("n").over(own)).withColumn("kinds", F.count(F.when(F.col("n") > 0, 1)).over(own))
    p = F.when(F.col("all") >= min_count, (F.col("n") + F.col("kinds") * F.col("before")) / (F.col("all") + F.col("kinds")))
    diverges = F.sum(F.col("n") * F.log(F.col("p") / F.col("before"))).over(own) > F.col("kinds") * gain
    key = F.shiftleft("context", 8).bitwiseOR(F.col("byte")).alias("key")
    return rows.withColumn("p", p).select(key, "n", "p", F.coalesce(diverges, F.lit(False)).alias("own"))


@dataclass
class Tree:
    """windows: (key, n, log_p), the log10 probability of each counted window; contexts: (k, context), those retained, by length."""

    depth: int
    windows: DataFrame
    contexts: DataFrame


def learn_tree(counted: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, gain: float = GAIN) -> Tree:
    """The tree from count_corpus(), as stored tables."""
    levels = {depth: counted.filter("kind = 1").select("key", "n")}
    for k in range(depth - 1, -1, -1):
        levels[k] = store(levels[k + 1].groupBy(_shorter(F.col("key")).alias("key")).agg(F.sum("n").alias("n")), "level")
    total = levels[0].agg(F.sum("n")).first()[0] or 0
    found = [levels[0].select("key", "n", ((F.col("n") + ADD) / (total + ADD * SYMBOLS)).alias("p"), F.lit(True).alias("own"))]
    for k in range(1, depth + 1):
        found.append(store(_level(levels[k], found[-1], min_count, gain), "smoothed"))
    kept: list[DataFrame] = []
    for k in range(depth, 0, -1):
        ends = found[k].filter("own").select(F.shiftright("key", 8).alias("context"))
        if kept:
            ends = ends.unionByName(kept[-1].select(F.shiftright("context", 8).alias("context")))
        kept.append(store(ends.distinct(), "kept"))
    kept.reverse()
    # From the shortest contexts up: a retained one decides, any other leaves it to its suffix.
    best = found[0].select("key", "p")
    for rows, contexts in zip(found[1:], kept):
        rows = rows.withColumn("context", F.shiftright("key", 8)).withColumn("shorter", _shorter(F.col("key")))
        rows = rows.join(contexts.withColumn("kept", F.lit(True)).hint("merge"), "context", "left")
        rows = rows.join(best.select(F.col("key").alias("shorter"), F.col("p").alias("less")).hint("merge"), "shorter")
        best = rows.select("key", "n", F.when(F.col("kept"), F.col("p")).otherwise(F.col("less")).alias("p"))
    scored = store(best.select("key", "n", F.log10("p").cast("float").alias("log_p")), "windows")
    contexts = counted.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("context"))
    for k, c in enumerate(kept, 1):
        contexts = contexts.unionByName(c.select(F.lit(k).alias("k"), "context"))
    discard(*(levels[k] for k in range(depth)), *found[1:])
    return Tree(depth, scored, contexts)


SCORED = "n_tokens long, heavy_known long, heavy_score double, heavy_p double, rare_kind array<byte>, rare array<long>, rare_n array<long>"


@dataclass
class Sent:
    """Words and windows that stand often, ascending: their hashes or numbers, and log10 probabilities."""

    depth: int
    words: np.ndarray
    word_logs: np.ndarray
    windows: np.ndarray
    window_logs: np.ndarray


def _places(sent: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in `sent`, ascending; the place after all of them where it isn't there."""
    at = np.searchsorted(sent, keys)
    return np.where((np.append(sent, 0)[at] == keys) & (at < len(sent)), at, len(sent))


def _tally(owner: np.ndarray, codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, times), ascending by owner: how often each text has each of `keys`, which codes point to."""
    pairs, times = np.unique(owner.astype(np.int64) * max(1, len(keys)) + codes, return_counts=True)
    return pairs // max(1, len(keys)), keys[pairs % max(1, len(keys))] if len(pairs) else np.zeros(0, np.int64), times


def _score_windows(batch: Batch, sent: Sent) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sum of the sent windows' log10 probabilities by text, and (owner, key, times) of the others.

    A window and its text are one number, so that sorting these counts them; a text is summed in the order of its windows' numbers.
    """
    keys = windows(batch, sent.depth)
    edges = np.cumsum(batch.scored)[batch.starts + sent.depth] - 1  # each text has one window at least
    pairs = keys.view(np.uint64)
    pairs <<= np.uint64(8)
    pairs |= np.repeat(np.arange(len(edges), dtype=np.uint8), np.diff(edges, append=len(keys)))
    pairs.sort()
    first, times = _runs(pairs)
    pairs = pairs[first]
    owner, keys = pairs.astype(np.uint8).astype(np.int64), (pairs >> np.uint64(8)).view(np.int64)
    first, copies = _runs(keys)
    places = np.repeat(_places(sent.windows, keys[first]), copies)
    scores = np.bincount(owner, np.append(sent.window_logs, np.float32(0))[places].astype(np.float64) * times, len(edges))
    others = places == len(sent.windows)
    return scores, (owner[others], keys[others], times[others])


def _score(batches: Iterator[pa.RecordBatch], sent: Sent, text: int) -> Iterator[pa.RecordBatch]:
    logs = np.r_[sent.word_logs, 0.0]
    heavy = len(sent.words)
    end_hash = _hash(pa.array([""]))
    end_at = _places(sent.words, end_hash)[0]
    for b in slices(batches):
        n = b.num_rows
        batch = Batch.read(b.column(text), sent.depth)
        scores, others = _score_windows(batch, sent)
        rare, kinds = [others], [1]
        coded = batch.tokens.dictionary_encode()
        hashes = _hash(coded.dictionary)
        codes = coded.indices.to_numpy()
        where = _places(sent.words, hashes)[codes]
        known = where < heavy
        tokens = np.diff(batch.bounds) + 1
        common = np.bincount(batch.owner[known], minlength=n) + (end_at < heavy)
        base = np.bincount(batch.owner, logs[where], minlength=n) + logs[end_at]
        rare.append(_tally(batch.owner[~known], codes[~known], hashes))
        kinds.append(0)
        if end_at == heavy:
            rare.append((np.arange(n), np.full(n, end_hash[0]), np.ones(n, np.int64)))
            kinds.append(0)
        whose, keys, times = (np.concatenate(x).astype(np.int64) for x in zip(*rare))
        kind = np.repeat(np.array(kinds, np.int8), [len(x[0]) for x in rare])
        order = np.argsort(whose, kind="stable")
        edges = pa.array(np.searchsorted(whose[order], np.arange(n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (kind, keys, times)]
        kept = [i for i in range(b.num_columns) if i != text]
        made = [pa.array(tokens.astype(np.int64)), pa.array(common.astype(np.int64)), pa.array(base), pa.array(scores), *lists]
        yield pa.record_batch([*(b.column(i) for i in kept), *made], names=[*(b.schema.names[i] for i in kept), *(x.split()[0] for x in SCORED.split(", "))])
        pa.default_memory_pool().release_unused()


def _frequent(table: DataFrame, most: int) -> Column:
    """Which rows of `table` have the largest n: at most `most` of them, in whole bins of n that are 9 % wide."""
    size = F.floor(F.log2("n") * 8)
    bins = sorted(table.filter("n > 0").groupBy(size.alias("size")).count().collect(), reverse=True)
    least, sent = math.inf, 0
    for s, count in bins:
        sent += count
        if sent > most:
            break
        least = s
    return F.coalesce((F.col("n") > 0) & (size >= F.lit(least)), F.lit(False))


def _fetch(table: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a table as arrays, by ascending `key`, a share at a time."""
    shares = -(-table.count() // FETCH) or 1
    got = [table.filter(F.pmod(F.xxhash64("key"), F.lit(shares)) == i).select("key", *columns).toArrow() for i in range(shares)]
    arrays = [np.concatenate([t.column(c).to_numpy() for t in got]) for c in ("key", *columns)]
    del got
    order = np.argsort(arrays[0])
    return [x[order] for x in arrays]


def score(docs: DataFrame, keep: list[str], counted: DataFrame, tree: Tree, text: str = "text", heavy_share: float = HEAVY_SHARE, most: int = SENT_WINDOWS) -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, train_tokens, base_score and score.

    counted and tree: of count_corpus(), which must have read these texts among others, and learn_tree(). A window that
    isn't there is an error.
    """
    spark = docs.sparkSession
    words = counted.filter("kind = 0").select("key", "n")
    total, different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    z = total + ADD * (different + 1)
    least = max(1, math.ceil(heavy_share * total))
    frequent = _frequent(tree.windows, most)
    keys, counts = _fetch(words.filter(F.col("n") >= least), "n")
    model = Sent(tree.depth, keys, np.log10((counts + ADD) / z), *_fetch(tree.windows.filter(frequent), "log_p"))
    sent = spark.sparkContext.broadcast(model)
    del model, keys, counts
    given = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, text)
    fields = ", ".join(["_row long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), SCORED])
    rows = store(given.mapInArrow(lambda it: _score(it, sent.value, len(keep) + 1), fields), "scored")
    sent.destroy()
    listed = F.arrays_zip(F.col("rare_kind").alias("kind"), F.col("rare").alias("key"), F.col("rare_n").alias("times"))
    rare = rows.select("_row", F.explode(listed).alias("w")).select("_row", "w.kind", "w.key", "w.times")
    light = words.filter(F.col("n") < least).select(F.lit(0).cast("byte").alias("kind"), "key", "n", F.log10((F.col("n") + ADD) / z).alias("log_p"))
    light = light.unionByName(tree.windows.filter(~frequent).select(F.lit(1).cast("byte").alias("kind"), "key", "n", F.col("log_p").cast("double")))
    unknown = F.when(F.col("kind") == 0, F.lit(math.log10(ADD / z))).otherwise(F.raise_error(F.lit("a text that count_corpus() hasn't read")).cast("double"))
    units = F.round(F.col("times") * F.coalesce("log_p", unknown) * UNIT).cast("long")
    word, window = F.col("kind") == 0, F.col("kind") == 1
    sums = rare.join(light, ["kind", "key"], "left").groupBy("_row").agg(
        F.sum(F.when(word, units).otherwise(0)).alias("s"),
        F.sum(F.when(window, units).otherwise(0)).alias("p"),
        F.sum(F.when(word & (F.col("n") > 0), F.col("times")).otherwise(0)).alias("known"),
    )
    return rows.join(sums, "_row", "left").select(
        *keep, "n_tokens", (F.col("heavy_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("heavy_score") + F.coalesce("s", F.lit(0)) / UNIT).alias("base_score"), (F.col("heavy_p") + F.coalesce("p", F.lit(0)) / UNIT).alias("score"),
    )


def held_out(doc_id: str | Column = "doc_id", modulus: int = 10, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", held_out().alias("held_out"), "text")
    counted = count_corpus(docs, training=~F.col("held_out"))
    return score(docs, ["doc_id", "held_out"], counted, learn_tree(counted))
