import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents, prose
from tessera.llm import suffix_lm as S


def plain_tree(texts, depth, least, gain):
    """Counts, retained contexts and probabilities by dictionaries of byte strings."""
    count = defaultdict(Counter)
    for t in texts:
        s = bytes([S.END]) * depth + b" ".join(t.encode().lower().split()) + bytes([S.END])
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                count[s[i - k : i]][s[i]] += 1
    total = sum(count[b""].values())
    wanted = {c for c in count if not c or sum(count[c].values()) >= least}

    def p(c, x):
        if not c:
            return (count[c][x] + S.ADD) / (total + S.ADD * S.SYMBOLS)
        n, k = sum(count[c].values()), len(count[c])
        return (count[c][x] + k * p(c[1:], x)) / (n + k)

    kept = {c for c in wanted if not c or sum(n * math.log(p(c, x) / p(c[1:], x)) for x, n in count[c].items()) > gain * len(count[c])}
    kept |= {c[i:] for c in kept for i in range(len(c) + 1)}
    return p, kept


@pytest.mark.parametrize(("least", "most"), [(5, 1 << 20), (2, 1 << 20), (2, 500), (2, 0)])
def test_tree_against_plain(spark, least, most):
    depth = S.DEPTH
    texts = [prose(40, i) for i in range(30)] + ["the cat sat on the mat " * 20, "", "Été été\tÉTÉ"]
    probes = [texts[0], "the mat", "unseen zebra 中", "", texts[-2] + "x"]
    docs = documents(spark, list(enumerate(texts + probes)))
    counted = S.count_corpus(docs.repartition(3), training=F.col("doc_id") < len(texts))
    tree = S.learn_tree(counted, min_count=least, gain=1.0)
    p, kept = plain_tree(texts, depth, least, 1.0)
    assert tree.contexts.count() == tree.contexts.distinct().count() == len(kept)
    got = {r["doc_id"]: r["score"] for r in S.score(docs, ["doc_id"], counted, tree, most=most).collect()}
    for i, t in enumerate(texts + probes):
        s = bytes([S.END]) * depth + b" ".join(t.encode().lower().split()) + bytes([S.END])
        want = 0.0
        for j in range(depth, len(s)):
            c = next(s[j - k : j] for k in range(depth, -1, -1) if s[j - k : j] in kept)
            want += math.log10(p(c, s[j]))
        assert got[i] == pytest.approx(want, rel=1e-5, abs=1e-4)


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_windows_byte_by_byte(depth):
    import pyarrow as pa

    texts = ["the cat", "", None, "Été 中", "x" * 40]
    want = []
    for t in texts:
        s = bytes([S.END]) * depth + b" ".join((t or "").encode().lower().split()) + bytes([S.END])
        want += [int.from_bytes(s[i - depth : i][::-1] + s[i : i + 1], "big") for i in range(depth, len(s))]
    assert S.windows(S.Batch.read(pa.array(texts), depth), depth).tolist() == want


def test_texts_that_were_not_counted(spark):
    counted = S.count_corpus(documents(spark, [(1, "a b c")]))
    with pytest.raises(Exception, match="hasn't read"):
        S.score(documents(spark, [(2, "x y")]), ["doc_id"], counted, S.learn_tree(counted)).collect()


def test_slices_read_all_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "SLICE", 7)
    texts = [prose(i % 11, i) + " Éa\t\x1cb  " for i in range(60)] + [None, ""]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    got = [w for b in S.slices(iter([batch, batch.slice(0, 0)])) for w in S.Batch.read(b.column(0)).tokens.cast(pa.binary()).to_pylist()]
    assert got == [w for t in texts for w in (t or "").encode().lower().split()]


def test_distributions_sum_to_one(spark):
    counted = S.count_corpus(documents(spark, [(i, prose(50, i)) for i in range(20)]))
    deepest = sorted({r[0] >> 8 for r in counted.filter("kind = 1").select("key").collect()})
    some = deepest[:: max(1, len(deepest) // 50)]
    # Each byte after these contexts, and after one that no text has. 257 symbols: the last stands for what no text has.
    every = spark.createDataFrame([(1, (c << 8) + x, 0) for c in [*some, 0] for x in range(256)], counted.schema)
    tree = S.learn_tree(counted.unionByName(every).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    sums = tree.windows.groupBy((F.shiftright("key", 8)).alias("c")).agg(F.sum(F.pow(F.lit(10.0), F.col("log_p"))).alias("s"), F.count("*").alias("rows"))
    got = sums.filter("rows = 256").collect()
    assert len(got) == len(some) + 1
    for r in got:
        assert r["s"] == pytest.approx(1, rel=1e-3)


def test_tree_grows_with_corpus(spark):
    def size(n):
        return S.learn_tree(S.count_corpus(documents(spark, [(i, f"{zlib.crc32(b'%d' % (i // 2)):x} common words") for i in range(n)]))).contexts.count()

    assert size(4000) > 5 * size(400)


def test_sent_and_joined_agree(spark):
    docs = documents(spark, [(i, prose(30, i)) for i in range(40)] + [(None, None), (7, ""), (7, "a b")])
    counted = S.count_corpus(docs)
    tree = S.learn_tree(counted)
    one, many, none = (sorted(map(tuple, S.score(docs, ["doc_id"], counted, tree, most=n).fillna(-1).collect())) for n in (1 << 20, 400, 0))
    assert len(one) == 43
    for a, b, c in zip(one, many, none, strict=True):
        assert a[:5] == b[:5] == c[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-5) == pytest.approx(c[5], rel=1e-5)
    assert many == sorted(map(tuple, S.score(docs.repartition(5), ["doc_id"], counted, tree, most=400).fillna(-1).collect()))


def test_base_and_gain(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in S.op1_suffix_tree_scores(spark, data).collect()}
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs}
    c = Counter()
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 10:
            c.update([*w, b""])
    n, z = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    for d, w in words.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) + 1, sum(x in c for x in w) + (b"" in c), n, zlib.crc32(str(d).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((c.get(x, 0) + 0.1) / z) for x in [*w, b""]))


def test_held_out_gain(spark):
    held = [r for r in S.op1_suffix_tree_scores(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_are_joined(spark):
    docs = documents(spark, [(i, prose(30, i)) for i in range(40)]).select("doc_id", S.held_out().alias("held_out"), "text")
    counted = S.count_corpus(docs, training=~F.col("held_out"))
    tree = S.learn_tree(counted)
    one = S.score(docs, ["doc_id"], counted, tree).orderBy("doc_id").collect()
    two = S.score(docs, ["doc_id"], counted, tree, heavy_share=0.02).orderBy("doc_id").collect()
    three = S.score(docs, ["doc_id"], counted, tree, heavy_share=2.0).orderBy("doc_id").collect()
    for a, b, c in zip(one, two, three, strict=True):
        assert a["n_known"] == b["n_known"] == c["n_known"]
        assert a["base_score"] == pytest.approx(b["base_score"]) == pytest.approx(c["base_score"])


def test_words_are_told_apart():
    import pyarrow as pa

    words = ["", *(bytes([97 + i % 26]).decode() * n for i in range(26) for n in range(1, 80)), *(prose(1, i) + str(i) for i in range(3000)), "a\0", "a\0\0", "中文"]
    words = list(dict.fromkeys(words))
    got = S._hash(pa.array(words))
    assert len(set(got.tolist())) == len(words)
    assert (S._hash(pa.array(words[::-1], pa.large_string()))[::-1] == got).all() and (S._hash(pa.array(["x", *words]).slice(1)) == got).all()
    assert len(S._hash(pa.array([], pa.string()))) == 0


def test_windows_are_sorted_not_coded(monkeypatch):
    """Coding windows by hash took most of the time of counting and scoring."""
    import pyarrow as pa

    def coded(*_):
        raise AssertionError("windows are coded")

    texts = [prose(30, i) for i in range(20)] + ["", None, "x" * 300, "the mat the mat"]
    batch = S.Batch.read(pa.array(texts))
    keys, times = np.unique(S.windows(batch), return_counts=True)
    monkeypatch.setattr(S, "_tally", coded)
    sent = S.Sent(S.DEPTH, np.zeros(0, np.int64), np.zeros(0), keys[::2], np.arange(len(keys[::2]), dtype=np.float32))
    scores, (owner, rare, n) = S._score_windows(batch, sent)
    for i, t in enumerate(texts):
        own = S.windows(S.Batch.read(pa.array([t], pa.string()))).tolist()
        assert scores[i] == sum(float(np.searchsorted(keys, k) // 2) for k in own if np.searchsorted(keys, k) % 2 == 0)
        assert sorted(np.repeat(rare[owner == i], n[owner == i]).tolist()) == sorted(k for k in own if np.searchsorted(keys, k) % 2)
    learns = pa.array([True] * len(texts))
    rows = [r for b in S._count(iter([pa.record_batch([pa.array(texts), learns], names=["text", "l"])]), S.DEPTH) for r in b.to_pylist()]
    assert [(r["key"], r["n"]) for r in rows if r["kind"] == 1] == list(zip(keys.tolist(), times.tolist()))
