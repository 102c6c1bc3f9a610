import pytest

from helpers import documents, prose
from tessera.llm import mixing as M


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Share out by weight; give what is above the limits to the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix(spark):
    rows, i = [], 0
    for s, n, long in (("b", 300, 90), ("a", 40, 400), (None, 80, 30), ("ä", 200, 60), ("Z", 5, 10)):
        for _ in range(n):
            rows.append((i, prose(1 + (i * 7919) % long, i), "en", s))
            i += 1
    docs = documents(spark, rows).withColumn("size", M.word_count("text")).repartition(5)
    got = M.copies(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = r["source"]
        assert 0 <= r["copies"] <= 2
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        target[s] = r["target"]
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=3)
    again = {(r["doc_id"], r["copies"]) for r in M.copies(docs.repartition(2)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    # The rates are the exponential tilt: of a source below its limit, log rate is proportional to size up to the cap.
    tilt = {round(__import__("math").log(r["rate"]) / r["size"], 9) for r in got if r["source"] == "a" and 0 < r["size"] and r["rate"] < 1.999}
    assert len(tilt) == 1


def test_mixed_repeats_rows(spark):
    docs = documents(spark, [(i, prose(20 + i % 9, i), "en", f"s{i % 3}") for i in range(90)])
    plan = {r["doc_id"]: r["copies"] for r in M.copies(docs.withColumn("size", M.word_count("text"))).collect()}
    n = {}
    for r in M.mixed(docs).collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {k: v for k, v in plan.items() if v}
