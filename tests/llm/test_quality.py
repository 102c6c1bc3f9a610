import re
from collections import Counter

from helpers import ODD_TEXTS, documents, prose
from tessera.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts():
    for t in [*ODD_TEXTS, "a b c a b c", "x\nx\n \n \nx", "a b a b a b", "z " * 9]:
        assert Q.counts(t)[:5] == plain(t)


def test_bins(spark):
    import pyspark.sql.functions as F

    rows = spark.range(0, 700_000, 13).select("id", Q.bin_of(F.col("id")).alias("b")).select("id", "b", Q.value_of(F.col("b")).alias("v")).collect()
    last = -1
    for r in rows:
        assert r["v"] <= r["id"] < r["v"] * 129 / 128 + 1 and r["b"] >= last
        last = r["b"]


def test_verdicts(spark, data):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for r in Q.op5_adaptive_quality(spark, data).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and not r["base_failed"]:
            assert r["kept"] == bool(labels[r["doc_id"]])


def test_thresholds_adapt(spark):
    """A source whose words are all long keeps them; one long-worded text among others goes."""
    long = lambda i: " ".join(f"{'w' * 14}{(i * 31 + j) % 977}" for j in range(60))
    rows = [(i, prose(60, i), "en", "short") for i in range(250)] + [(1000 + i, long(i), "en", "long") for i in range(250)] + [(5000, long(5), "en", "short")]
    kept = {r["doc_id"] for r in Q.judge(documents(spark, rows), ["doc_id"]).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - {5000}
    good = Q.keep_good(documents(spark, rows))
    assert good.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r["doc_id"] for r in good.collect()} == kept


def test_junk_goes_from_sources_full_of_it(spark):
    """A source of which 40 % is junk loses it, though its own upper quartile is junk; a single symbol is no junk."""
    junk = lambda i: " ".join(f"{w}###" for w in prose(60, i).split())
    rows = [(i, prose(60, i), "en", "a") for i in range(300)] + [(1000 + i, prose(60, 1000 + i), "en", "b") for i in range(60)] + [(2000 + i, junk(i), "en", "b") for i in range(40)]
    rows += [(5000, prose(200, 5) + " |" * 70, "en", "a"), (5001, prose(200, 6) + " |", "en", "a")]
    kept = {r["doc_id"] for r in Q.judge(documents(spark, rows), ["doc_id"]).filter("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] < 2000} | {5001}


def test_few_texts_lean_on_their_language(spark):
    """Thresholds change smoothly with the texts of a group: no number of them switches to another rule."""
    long = lambda i: " ".join(f"{'w' * 9}{(i * 31 + j) % 977}" for j in range(60))
    highs = []
    for n in (1, 20, 49, 50, 51, 199, 200, 201):
        rows = [(i, prose(60, i), "en", "a") for i in range(300)] + [(1000 + i, long(i), "en", "b") for i in range(n)]
        features = Q.count_features(documents(spark, rows), ["lang", "source"])
        highs.append({r["source"]: r["high_word_length"] for r in Q.thresholds(Q.sketch(features)).collect()}["b"])
    assert all(abs(highs[i + 1] - highs[i]) < 250 for i in (2, 3, 5, 6)), highs
