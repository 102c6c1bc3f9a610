from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import documents, prose
from tessera.llm import minhash_join as J


def plain(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (find(d), links[d]) for d in ids}


def near(i, j, n=120):
    w = prose(n, i).split()
    for k in range(j):
        w[(k * 29 + j * 7) % n] = f"edit{i}x{j}x{k}"
    return " ".join(w)


ROWS = [(i * 100 + j, near(i, j)) for i in range(12) for j in range(6)] + [(9000 + i, prose(60, 5)) for i in range(15)] + [(9100, prose(60, 5).upper()), (9200, None), (9201, ""), (9202, "a b"), (9203, "a  b"), (9204, " ")]


@pytest.mark.parametrize("block", [J.BLOCK_NODES, 3])
def test_against_all_pairs(spark, block):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.near_duplicates(documents(spark, ROWS).repartition(5), block_nodes=block).collect()}
    assert got == plain(ROWS)


def test_query_against_all_pairs(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.op10_minhash_jaccard_join(spark, data).collect()}
    assert got == plain(rows)


def test_keep_first(spark):
    kept = sorted(r["doc_id"] for r in J.keep_first(documents(spark, ROWS)).collect())
    assert kept == sorted({c for c, _ in plain(ROWS).values()})
    twice = documents(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "d e f g h"), (None, "q"), (None, "q")])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in J.keep_first(twice).collect()) == [(0, "q"), (1, "a b c"), (3, "d e f g h")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = defaultdict(set)
    for n, r in J.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r].add(n)
    assert got == {0: set(range(41)), 90: {90, 95, 100}}


def test_bands():
    assert (1 - 0.8**J.ROWS) ** J.bands() <= 1 - J.RECALL < (1 - 0.8**J.ROWS) ** (J.bands() - 1)
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], r.integers(0, 2**63, 100).astype(np.uint64)])
    v = J.min_hashes([a, b], 600)
    assert abs((v[0] == v[1]).mean() - 0.5) < 0.1
