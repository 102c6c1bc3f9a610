"""Document fingerprints that tell which paragraphs differ: invertible Bloom lookup tables, with DataFrame functions only.

A text's paragraphs are its lines, cut into pieces of at least so many characters (SCALES: shorter ones at a text's
beginning, so that short texts have several) that end before a blank, after one of ENDS, or before one of STARTS in
scripts without blanks. As content says where they end, pieces after an insertion are the same again. Their distinct
64-bit digests go into a table of three parts of m cells: each digest falls into one cell of each part, and a cell
holds how many fell there and the exclusive or of these digests and of their check values. Cells that are empty aren't
stored. Tables subtract cell by cell. Peeling the difference takes a digest out of a cell that holds only one, and out
of its other cells, and goes on until nothing is left: the differing digests have been recovered. The first m is that
which a sample of the digests, those divisible by STRATUM, lets expect to be enough; where peeling gets stuck it starts
again with a larger one. Only if the largest m failed as well would the digests be compared as sets.

The fingerprint is the table of the smallest m. The likeness of two texts is 1 - d / (a + b), with d the differing
digests and a and b those of each text.

Edge cases: a null or empty text has no digests, and the likeness of two such texts is 1; documents are ordered by id,
null first, then by the text's hash and the text; rows that repeat follow one another; the only document is its own
next one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, documents, global_index, let, sample_bounds, store

SCALES = ((64, 4), (384, 32), (None, 200))
"""How far into a text pieces have at least so many characters."""
LONGEST = 400
"""The most characters of a piece."""
ENDS = "adegknorsty.,;:!?0-9"
STARTS = "的了在是のをにが"
STRATUM = 8
SIZES = tuple(8 << (2 * i) for i in range(9))
"""Cells of each part of a table, in the order they are tried."""
ROUNDS = 48
FEW = 64
SEGMENTS = 1 << 16
"""Sampled ids between which buckets are cut, at most."""
BUCKET_ROWS = 1000

CELLS = "array<struct<c:int,n:int,k:bigint,h:bigint>>"


def pattern(least: int) -> str:
    """What a piece of at least so many characters is."""
    return f"[^\\n]{{{least},{max(LONGEST, least)}}}?(?:(?<=[{ENDS}])(?= )|(?=[{STARTS}]))|[^\\n]{{1,{LONGEST}}}"


def digests(text: Column, scales=SCALES) -> Column:
    """The distinct digests of a text's paragraphs."""
    parts, start = [], 1
    for end, least in scales:
        part = F.substring(text, F.lit(start), F.lit(end - start + 1 if end else 2**31 - 1))
        parts.append(F.regexp_extract_all(part, F.lit(f"({pattern(least)})"), 1))
        start = (end or 0) + 1
    return F.array_distinct(F.transform(F.concat(*parts), lambda p: F.xxhash64(p)))


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(9))


def _entries(keys: Column, m: Column, sign: int | None = 1) -> Column:
    """What each digest adds to its three cells, which its own bits name. keys: digests, or (with sign None) structs of a digest k and a count n to take away."""

    def three(x: Column) -> Column:
        k, n = (x, F.lit(sign)) if sign else (x["k"], -x["n"])
        cell = lambda i: (F.pmod(F.shiftrightunsigned(k, 21 * i), m.cast("long")) + i * m).cast("int")
        return let(_check(k), lambda h: F.array(*[F.struct(cell(i).alias("c"), n.alias("n"), k.alias("k"), h.alias("h")) for i in range(3)]))

    return F.flatten(F.transform(keys, three))


def fold(entries: Column) -> Column:
    """The non-empty cells that entries add up to, by cell."""

    def total(run: Column) -> Column:
        start = F.struct(F.element_at(run, 1)["c"].alias("c"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
        add = lambda a, x: F.struct(a["c"].alias("c"), (a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h"))
        return F.aggregate(run, start, add)

    def grouped(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["c"] != F.get(s, i - 1)["c"]))
        till = lambda f, j: F.coalesce(F.get(f, j + 1), F.size(s))
        runs = let(first, lambda f: F.transform(f, lambda at, j: F.when(till(f, j) - at == 1, F.get(s, at)).otherwise(total(F.slice(s, at + 1, till(f, j) - at)))))
        return F.filter(runs, lambda x: (x["n"] != 0) | (x["k"] != 0))

    return let(F.array_sort(entries), lambda s: F.when(F.size(s) == 0, F.array().cast(CELLS)).otherwise(grouped(s)))


def peel(cells: Column, m: Column) -> Column:
    """How many digests a difference holds, by recovering them all; null if it gets stuck."""

    def one(state: Column, _: Column) -> Column:
        pure = lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["h"])
        parted = F.struct(F.filter(state["cells"], pure).alias("one"), F.filter(state["cells"], lambda x: ~pure(x)).alias("more"))

        def take(p: Column) -> Column:
            # Sets of numbers are hashed; sets of structs would be compared pair by pair.
            side = lambda n: F.transform(F.array_distinct(F.transform(F.filter(p["one"], lambda x: x["n"] == n), lambda x: x["k"])), lambda k: F.struct(k.alias("k"), F.lit(n).alias("n")))
            keys = F.concat(side(1), side(-1))
            # Cells with one digest vanish with it. Where few others are left, only what falls into these is folded.
            others = lambda keys: let(F.transform(p["more"], lambda x: x["c"]), lambda ids: F.filter(_entries(keys, m, None), lambda x: F.array_contains(ids, x["c"])))
            few = lambda keys: fold(F.concat(p["more"], others(keys)))
            many = lambda keys: fold(F.concat(state["cells"], _entries(keys, m, None)))
            left = lambda keys: F.when(F.size(p["more"]) == 0, p["more"]).when(F.size(p["more"]) <= FEW, few(keys)).otherwise(many(keys))
            taken = let(keys, lambda keys: F.struct(left(keys).alias("cells"), F.concat(state["found"], keys).alias("found")))
            return F.when(F.size(p["one"]) == 0, state).otherwise(taken)

        return F.when(F.size(state["cells"]) == 0, state).otherwise(let(parted, take))

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<k:bigint,n:int>>").alias("found"))
    end = lambda s: F.when(F.size(s["cells"]) == 0, F.size(s["found"]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, end)


def difference(a: Column, b: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """How many digests are in one of two arrays only, by their tables' difference.

    Tables are linear, so the entries of one and the negated entries of the other are folded at once. Sizes too small
    for the arrays' lengths, or for what the sample lets expect, are skipped.
    """
    few = lambda x: F.filter(x, lambda k: F.pmod(k, F.lit(STRATUM)) == 0)
    apart = lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))
    expected = let(F.struct(few(a).alias("a"), few(b).alias("b")), lambda ab: STRATUM * apart(ab["a"], ab["b"]))
    least = F.greatest(F.abs(F.size(a) - F.size(b)), F.least(expected, F.size(a) + F.size(b)) * 3 / 4)

    def tried(ab: Column) -> Column:
        a, b = ab["a"], ab["b"]

        def attempt(found: Column, m: Column) -> Column:
            hopeless = ab["least"] > 0.6 * m
            return F.when(found.isNotNull() | hopeless, found).otherwise(peel(fold(F.concat(_entries(a, m), _entries(b, m, -1))), m))

        found = F.aggregate(F.array(*map(F.lit, sizes)), F.lit(None).cast("int"), attempt)
        return F.coalesce(found, apart(a, b))

    return let(F.struct(a.alias("a"), b.alias("b"), least.alias("least")), tried)


def likeness(a: Column, b: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - difference(a, b, sizes) / total)


def fingerprint(keys: Column) -> Column:
    """The smallest table as text: cell, count and digests of each non-empty cell in hexadecimal."""
    cell = lambda x: F.concat(F.hex(x["c"]), F.lit("."), F.hex(x["n"]), F.lit("."), F.hex(x["k"]))
    return F.lower(F.array_join(F.transform(fold(_entries(keys, F.lit(SIZES[0]))), cell), "-"))


def _below(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are at or below key, by binary search."""
    if not bounds:
        return F.lit(0)
    listed = F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(listed, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, text, keys, next_text, next_keys): each document with the one that follows by id; the first follows the last.

    Ids fall into buckets of neighbours: segments between sampled ids, each cut evenly; documents without an id by the
    hashes of their texts. Texts are shuffled once, by bucket; only the first document of each bucket is fetched for
    the last one of the bucket before.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ids = store(named.select("doc_id", "hash"), "ids")
    n, without, least, most = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    bounds = sample_bounds(ids.select(F.col("doc_id").alias("id")), min(segments, -(-n // bucket_rows)))
    edges = [least or 0, *bounds, (most or 0) + 1]
    parts = max(1, -(-n // (bucket_rows * (len(bounds) + 1))))
    bare = max(1, -(-(without or 0) // bucket_rows))

    def bucketed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_s", _below(bounds, F.col("doc_id")))
        if parts > 1:
            low, high = (F.get(F.from_json(F.lit(str([float(x) for x in side])), "array<double>"), F.col("_s")) for side in (edges[:-1], edges[1:]))
            part = F.least(F.floor((F.col("doc_id").cast("double") - low) * parts / F.greatest(high - low, F.lit(1.0))), F.lit(parts - 1))
        else:
            part = F.lit(0)
        spread = F.least(F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * bare), F.lit(bare - 1)) - bare
        return df.withColumn("bucket", F.when(F.col("doc_id").isNull(), spread).otherwise(F.col("_s").cast("long") * parts + part).cast("long")).drop("_s")

    rows = bucketed(named).withColumn("keys", digests(F.col("text")))
    firsts = bucketed(ids).groupBy("bucket").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    firsts = store(global_index(firsts, "bucket", "i"), "firsts")
    m = max(1, firsts.count())
    before = firsts.select(F.col("bucket").alias("before"), F.pmod(F.col("i") + 1, F.lit(m)).alias("i"))
    after = store(firsts.join(before, "i").select("before", "first.*"), "after")
    discard(ids, firsts)
    heads = named.alias("d").join(after.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.hash") == F.col("a.hash"))).groupBy("before").agg(F.min("text").alias("head"))
    heads = store(heads.withColumn("head_keys", digests(F.col("head"))), "heads")
    discard(after)
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "hash", "text")
    led = rows.withColumn("next", F.lead(F.struct("text", "keys")).over(w))
    joined = led.join(heads, led["bucket"] == heads["before"], "left")
    return joined.select("doc_id", "text", "keys", F.coalesce("next.text", "head").alias("next_text"), F.coalesce("next.keys", "head_keys").alias("next_keys"))


def op7_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(documents(spark, sf_dir))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "keys", "next_keys", edited.alias("edited"))
    docs = docs.select("doc_id", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_keys"))
    return docs.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("keys")).alias("fingerprint"), fingerprint(F.col("edited_keys")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys")).alias("near_edited"), likeness(F.col("keys"), F.col("next_keys")).alias("near_next"),
    )
