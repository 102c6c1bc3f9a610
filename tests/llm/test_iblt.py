import hashlib
import re

import pyspark.sql.functions as F
import pytest

from helpers import documents, prose
from tessera.llm import iblt as B


def pieces(t):
    out, start = set(), 0
    for end, least in B.SCALES:
        out |= {m.group() for m in re.finditer(B.pattern(least), t[start:end])}
        start = end
    return out


def like(a, b):
    a, b = pieces(a), pieces(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def test_query_against_sets(spark, tmp_path):
    texts = [None, "", "short", *["\n".join(prose(30, (i * 7 + j) % 40) for j in range(1 + i % 9)) for i in range(120)], "\n".join(prose(30, j) for j in range(400)), "\n".join(prose(30, 5000 + j) for j in range(300))]
    docs = documents(spark, [(i * 3 - 50, t) for i, t in enumerate(texts)])
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in B.op7_iblt_fingerprints(spark, str(tmp_path)).collect()}
    texts = [t or "" for t in texts]
    prints = {}
    for i, t in enumerate(texts):
        n, r = texts[(i + 1) % len(texts)], got[i * 3 - 50]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(t, e)) and r["near_next"] == pytest.approx(like(t, n))
        assert prints.setdefault(frozenset(pieces(t)), r["fingerprint"]) == r["fingerprint"]
        if pieces(e) in map(set, prints):
            assert prints[frozenset(pieces(e))] == r["edited_fingerprint"]


def test_neighbours_in_small_buckets(spark):
    ids = [None, -5, 0, 1, 2, 3, 1000, 1001, 1002, 50_000, 2**62]
    docs = documents(spark, [(i, f"text {i}") for i in ids])
    for rows in (1, 2, 3, 100):
        got = {r["text"]: r["next_text"] for r in B.with_next(docs.repartition(4), bucket_rows=rows, segments=4).collect()}
        assert got == {f"text {i}": f"text {ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_small_tables_fail_and_larger_ones_recover(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.xxhash64(i)).alias("a"), F.transform(F.sequence(F.lit(41), F.lit(90)), lambda i: F.xxhash64(i)).alias("b"))
    of = lambda m: B.peel(B.fold(F.concat(B._entries(F.col("a"), F.lit(m)), B._entries(F.col("b"), F.lit(m), -1))), F.lit(m))
    r = df.select(of(8).alias("small"), of(128).alias("large"), B.difference(F.col("a"), F.col("b")).alias("d"), B.difference(F.col("a"), F.col("b"), (2, 3)).alias("fallback")).first()
    assert r["small"] is None and r["large"] == r["d"] == r["fallback"] == 70


def test_documents_without_ids_spread(spark):
    """Their order is that of their texts' hashes, whatever the buckets."""
    docs = documents(spark, [(None, f"text {i}") for i in range(40)] + [(None, "text 7")] * 3 + [(5, "five"), (6, "six")])
    found = []
    for rows in (1, 3, 7, 1000):
        got = B.with_next(docs.repartition(4), bucket_rows=rows)
        found.append(sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got.collect()))
    assert all(x == found[0] for x in found) and len({n for _, t, n in found[0]}) == 42


def test_clustered_ids(spark):
    """Buckets hold like numbers of documents though nearly all ids are close to one another."""
    docs = documents(spark, [(i, f"t {i}") for i in range(2000)] + [(10**12 + i * 10**9, "far") for i in range(20)])
    rows = B.with_next(docs, bucket_rows=50)
    assert {r["doc_id"]: r["next_text"] for r in rows.collect()}[1234] == "t 1235"


def test_halves_and_shifts_are_found(spark):
    """Of a text of any length from some words up an unchanged half is recovered, and what follows an insertion too."""
    rows = []
    for i, n in enumerate((6, 8, 10, 20, 40, 80, 200, 800)):
        t, other = prose(n, i), prose(n, 1000 + i)
        h = len(t) // 2
        rows.append((i, t, t[: len(t) - h] + other[:h], "Xy" + t))
    df = spark.createDataFrame(rows, "i int, a string, b string, c string").select("i", *[B.digests(F.col(c)).alias(c) for c in "abc"])
    for r in df.select("i", B.likeness(F.col("a"), F.col("b")).alias("half"), B.likeness(F.col("a"), F.col("c")).alias("shifted")).collect():
        assert 0.1 < r["half"] < 0.85, r
        assert r["shifted"] > 0.1, r


def test_long_texts_in_time(spark):
    """Two different texts of 16,000 lines: one table that is large enough is tried."""
    import time

    df = spark.createDataFrame([("\n".join(prose(12, i) for i in range(16_000)), "\n".join(prose(12, 50_000 + i) for i in range(16_000)))], "a string, b string")
    start = time.time()
    r = df.select(B.digests(F.col("a")).alias("a"), B.digests(F.col("b")).alias("b")).select(F.size(F.array_except("a", "b")).alias("x"), F.size(F.array_except("b", "a")).alias("y"), B.difference(F.col("a"), F.col("b")).alias("d")).first()
    print("seconds", time.time() - start)
    assert r["d"] == r["x"] + r["y"] > 30_000 and time.time() - start < 60
