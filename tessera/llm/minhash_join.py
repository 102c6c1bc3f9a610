"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed word n-grams (lower-case words; a text of fewer words is one n-gram). Exact copies are one
node. MinHash values are cut into bands, their number chosen for the target recall at the threshold; nodes that share
a band hash are joined by an edge to the bucket's smallest node, and the connected groups of these edges are the
candidates. Each group's nodes meet once with their full n-gram sets, in blocks of bounded size, where all pairs are
verified exactly: within a group no link is lost, and no row is made of a pair. A task returns each node's links in
its pair of blocks, and edges to the smallest linked node; these edges' connected components are the classes.

Nodes are 64-bit hashes of the lower-case words. All bucket, edge and component steps are hash aggregations and joins
over narrow rows.

Edge cases: a null text or one without words has no n-grams, so it links to nothing and is a class of its own (its
class_id is its doc_id); repeated rows are copies of each other; a null doc_id is never a class_id unless the class
has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, documents, store, tidy

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 6
"""MinHash values in a band."""
BLOCK_NODES = 128
BLOCK_GRAMS = 1 << 20
"""A block holds about so many nodes, and n-grams, at most."""
MOST_FILTER_BITS = 31
"""The filter of candidate texts has 16 to 32 bits a candidate, at most two to this power (256 MB); what it lets through is joined exactly."""
SEED = 7919
KNOWN_WORDS = 250_000

M64 = (1 << 64) - 1


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that catch a pair at the threshold with at least this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_steps = [int(x) | 1 for x in np.random.Generator(np.random.PCG64(SEED)).integers(0, M64, 64, dtype=np.uint64)]


def gram_hashes(text: str | None, words: int = WORDS) -> tuple[int | None, np.ndarray]:
    """The node of a text (null without words), and the hashes of its n-grams in order, repeats included."""
    import xxhash

    tokens = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not tokens:
        return None, np.zeros(0, np.uint64)
    if len(_words) > KNOWN_WORDS:
        _words.clear()
    ids = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    node = xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    n = min(words, len(ids))
    h = np.full(len(ids) - n + 1, np.uint64(n))
    for i in range(n):
        h = (h ^ ids[i : len(ids) - n + 1 + i]) * np.uint64(_steps[i % 64])
        h ^= h >> np.uint64(31)
    return node - (1 << 64) if node >> 63 else node, _mix(h)


def min_hashes(grams: list[np.ndarray], count: int) -> np.ndarray:
    """(texts, count) MinHash values of non-empty lists of n-gram hashes."""
    draw = np.random.Generator(np.random.PCG64(SEED + 1))
    odd = draw.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = draw.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.empty((len(grams), count), np.uint32)
    at = 0
    while at < len(grams):
        end, size = at, 0
        while end < len(grams) and (end == at or size + len(grams[end]) <= 1 << 17):
            size += len(grams[end])
            end += 1
        x = (np.concatenate(grams[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(g) for g in grams[at : end - 1])])
        for k in range(count):
            v = x * odd[k] + plus[k]
            v ^= v >> np.uint32(15)
            out[at:end, k] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), starts)
        at = end
    return out


def band_hashes(values: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) bucket hashes; buckets of different bands differ."""
    n = values.shape[1] // rows
    h = np.tile(_mix(np.arange(1, n + 1, dtype=np.uint64)), (len(values), 1))
    for i in range(rows):
        h = _mix(h ^ values[:, i::rows][:, :n].astype(np.uint64)) * np.uint64(_steps[i])
    return h.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch], words: int, n_bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for b in tidy(batches):
        found = [gram_hashes(t.as_py(), words) for t in b.column(1)]
        some = [i for i, (_, g) in enumerate(found) if len(g)]
        buckets: list = [None] * len(found)
        if some:
            hashes = band_hashes(min_hashes([found[i][1] for i in some], n_bands * rows), rows)
            for i, h in zip(some, hashes, strict=True):
                buckets[i] = h
        yield pa.record_batch([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(g) for _, g in found], pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "node", "grams", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch], words: int, bits: np.ndarray, power: int) -> Iterator[pa.RecordBatch]:
    for b in tidy(batches):
        nodes, sets = [], []
        for t in b.column(0):
            node, grams = gram_hashes(t.as_py(), words)
            if node is None:
                continue
            place = int(_mix(np.array([node & M64], np.uint64))[0]) >> (64 - power)
            if bits[place >> 6] >> np.uint64(place & 63) & np.uint64(1):
                nodes.append(node)
                sets.append(np.unique(grams).view(np.int64))
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])


def linked(one: list[np.ndarray], other: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of each pair of sets (sorted arrays) of two lists reaches the threshold."""
    sizes = [np.array([len(x) for x in side], np.float64) for side in (one, other)]
    if len(one) * len(other) <= 4:
        common = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in other] for a in one], np.float64)
    else:
        common = np.zeros((len(one), len(other)))
        everything = np.concatenate([*one, *other])
        side = np.repeat(np.arange(len(one) + len(other)), [len(x) for x in (*one, *other)])
        grams, place, times = np.unique(everything, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        column = np.full(len(grams), -1)
        column[shared] = np.arange(len(shared))
        column = column[place]
        keep = column >= 0
        side, column = side[keep], column[keep]
        for low in range(0, len(shared), 8192):
            mine = (column >= low) & (column < low + 8192)
            dense = np.zeros((len(one) + len(other), min(8192, len(shared) - low)), np.float32)
            dense[side[mine], column[mine] - low] = 1
            common += dense[: len(one)] @ dense[len(one) :].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return common >= threshold * union - 1e-9


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest item that each of n items is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, low, high): a cell of a group's pairs of blocks each."""
    cell, held = None, []

    def done() -> list[tuple[int, int, int]]:
        _, low, high = cell
        one = [x for x in held if x[0] == low]
        other = one if low == high else [x for x in held if x[0] == high]
        if not one or not other:
            return []
        yes = linked([x[3] for x in one], [x[3] for x in other], threshold)
        if low == high:
            np.fill_diagonal(yes, False)
        weight = np.array([x[2] for x in other])
        links = yes @ weight
        a, b = np.nonzero(yes)
        nodes = [x[1] for x in one] if low == high else [x[1] for x in one] + [x[1] for x in other]
        order = np.argsort(np.array(nodes))
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        if low != high:
            links = np.concatenate([links, np.array([x[2] for x in one]) @ yes])
            b = b + len(one)
        root = _roots(len(nodes), rank[a], rank[b])
        return [(n, int(c), nodes[order[root[rank[i]]]]) for i, (n, c) in enumerate(zip(nodes, links, strict=True)) if c]

    def batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], names=["node", "links", "to"])

    for b in tidy(batches):
        root, low, high, block, node, copies = (b.column(i).to_pylist() for i in range(6))
        sets = b.column(6)
        out: list = []
        for i in range(b.num_rows):
            if (root[i], low[i], high[i]) != cell:
                if held:
                    out += done()
                cell, held = (root[i], low[i], high[i]), []
            held.append((block[i], node[i], copies[i], np.asarray(sets[i].values)))
        yield batch(out)
    if held:
        yield batch(done())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b), root the smallest node of its connected component.

    Alternates large-star and small-star steps until nothing changes; each is an aggregation and a join by node.
    """

    def count(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = store(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        joined = both.join(least, "a")
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        out = store(moved.filter("a <> b").distinct(), "edges")
        discard(least, e)
        return out

    now = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while (state := count(now)) != before and state[0]:
        before = state
        now = step(step(now, True), False)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    out = store(roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    discard(now)
    return out


def _filter(nodes: DataFrame, power: int) -> np.ndarray:
    """A bit set of hashed nodes: it tells most texts that aren't candidates before their sets move."""
    place = nodes.mapInArrow(lambda it: (pa.record_batch([pa.array((_mix(b.column(0).to_numpy().astype(np.int64).view(np.uint64)) >> np.uint64(64 - power)).astype(np.int64))], names=["p"]) for b in it), "p long")
    words = place.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v")).collect()
    bits = np.zeros(1 << (power - 6), np.uint64)
    for w, v in words:
        bits[w] = v & M64
    return bits


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block_nodes: int = BLOCK_NODES, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies), one row for each row of docs.

    class_id: the smallest doc_id of the rows connected with it by links. n_links: the other rows whose similarity is
    at least the threshold, copies included. n_copies: the rows with the same words, itself included.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    keys_schema = T.StructType([T.StructField("doc_id", kind), T.StructField("node", T.LongType()), T.StructField("grams", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType()))])
    n_bands = bands(threshold, recall, rows)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = store(named.mapInArrow(lambda it: _keys(it, words, n_bands, rows), keys_schema), "keys")
    nodes = store(keys.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("grams").alias("grams")), "nodes")

    entries = store(keys.filter("node is not null").select("node", F.explode("buckets").alias("bucket")).distinct(), "entries")
    shared = store(entries.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b <> last").select("bucket", "b"), "buckets")
    star = entries.join(shared, "bucket").filter("node <> b").select(F.col("node").alias("a"), "b")
    groups = components(star)
    discard(entries, shared)

    size = groups.join(nodes, "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("grams").alias("g"))
    size = store(size.select("root", F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("g") / block_grams)).cast("int").alias("blocks")), "groups")
    members = store(groups.join(size, "root").join(nodes, "node").select("node", "root", "blocks", "copies"), "members")
    power = min(MOST_FILTER_BITS, max(10, (16 * members.count()).bit_length()))
    bits = spark.sparkContext.broadcast(_filter(members.select("node"), power))
    discard(groups, size)
    sets = named.select("text").mapInArrow(lambda it: _sets(it, words, bits.value, power), "node long, set array<long>")
    sets = members.join(sets.dropDuplicates(["node"]), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "o").alias("low"), F.greatest("block", "o").alias("high"), "block", "node", "copies", "set")
    found = store(cells.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(lambda it: _verify(it, threshold), "node long, links long, to long"), "links")

    classes = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    discard(members)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = store(placed, "placed")
    discard(nodes, classes, found)
    ids = store(placed.groupBy("root").agg(F.min("first").alias("class_id")), "ids")
    last, placed = placed, store(placed.join(ids, "root").select("node", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    discard(last, ids)
    out = keys.select("doc_id", "node").join(placed, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class of near_duplicates(): that with the smallest doc_id.

    Rows that share an id and a text stay once. Rows without an id belong to no class's choice: they stay, also once a text.
    What is dropped grows with the documents, so the join sorts and merges at every size.
    """
    found = store(near_duplicates(docs, doc_id, text, **options), "duplicates")
    dropped = found.filter("doc_id is not null and doc_id <> class_id").select(F.col("doc_id").alias("_drop")).distinct()
    again = store(found.filter("doc_id is null or doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    left = docs.join(dropped.hint("merge"), docs[doc_id] == dropped["_drop"], "left_anti")
    if not again.limit(1).count():
        return left
    repeats = left[doc_id].eqNullSafe(again["doc_id"])
    return left.join(again, repeats, "left_anti").unionByName(left.join(again, repeats, "left_semi").dropDuplicates([doc_id, text]))


def op10_minhash_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
