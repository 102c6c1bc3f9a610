"""Normalisation and string similarities against hand-written values and naive definitions."""

import random
from functools import lru_cache

import pyspark.sql.functions as F
import pytest

from tessera.functions import normalise as N
from tessera.functions import similarity as S


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, norm, core",
    [
        ("Aviva Industries Group Private Limited", "aviva industries group private limited", "aviva  group"),
        ("PRIVATE LOTUS BLUE IT LIMITED", "private lotus blue it limited", "private lotus blue it"),
        ("GARCIAAGUILARSYSTEM.COM", "garciaaguilarsystem com", "garciaaguilarsystem com"),
        ("steimelcapitalchurchill.com", "steimelcapitalchurchill", "steimelcapitalchurchill"),
        ("https://www.acme.co.in/shop", "acme shop", "acme shop"),
        ("Soledad Líquor lnc", "soledad l quor lnc", "soledad l quor lnc"),
        ("आदित्य", "", ""),
        ("name.comé x", "name  x", "name  x"),
        ("a.community", "a community", "a community"),
        (None, "", ""),
        ("", "", ""),
        ("!!!", "", ""),
    ],
)
def test_names(spark, raw, norm, core):
    got = one(spark, N.norm_text, raw), one(spark, N.clean_legal, raw)
    assert (" ".join(got[0].split()), " ".join(got[1].split())) == (" ".join(norm.split()), " ".join(core.split()))


def test_tokens_and_numbers(spark):
    assert one(spark, lambda c: N.get_token(c, 2), "a  b") == ""
    assert one(spark, lambda c: N.get_token(c, 3), "a b") == ""
    assert one(spark, lambda c: N.get_token(c, 3, "audit"), "a b") is None
    assert one(spark, N.postal, "5617 Grove Cove Drive 75071") == "5617"
    assert one(spark, lambda c: N.postal(c, "audit"), "5617 Grove Cove Drive 75071") == "75071"
    assert one(spark, N.door, "404-406 LOCKSLEY") == "404" and one(spark, N.door, "TX 5617") == ""
    assert one(spark, N.clean_addr, " 5617  Grove,Cove ") == "5617 grove cove"
    assert one(spark, N.digit_set, "12 a 7 12 b3 7") == ["12", "7"]


def test_python_dialect(spark):
    df = spark.createDataFrame([("Café Crème SARL", "12 St. Marks Rd, Apt 4"), ("Ltd", None), (None, "")], "n string, a string")
    full, core = N.clean_business_name("n")
    address, numbers = N.clean_address("a")
    got = [tuple(r) for r in df.select(full, core, address, numbers).collect()]
    assert got == [("cafe creme sarl", "cafe creme", "12 street marks road unit 4", ["12", "4"]), ("ltd", "ltd", "", []), ("", "", "", [])]


@lru_cache(None)
def lcs(a, b):
    if not a or not b:
        return 0
    return lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))


def test_ratio_is_the_common_subsequence():
    r = random.Random(1)
    for _ in range(400):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert S.common_subsequence(a, b) == lcs(a, b)
        assert S.ratio(a, b) == S.ratio(b, a) and 0 <= S.token_set_ratio(a, b) <= 1
        windows = [S.ratio(x, y[max(0, e - len(x)) : e]) for x, y in ((a, b), (b, a)) if len(x) <= len(y) for e in range(1, len(y) + len(x))]
        if a and b:
            assert S.partial_ratio(a, b) == pytest.approx(max(windows))


@pytest.mark.parametrize(
    "f, a, b, want",
    [
        (S.ratio, "", "", 1.0), (S.ratio, "a", "", 0.0), (S.ratio, "kitten", "sitting", 8 / 13), (S.token_sort_ratio, "new york mets", "mets york new", 1.0), (S.token_sort_ratio, "", "", 1.0),
        (S.token_set_ratio, "fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0), (S.token_set_ratio, "", "x", 0.0), (S.token_set_ratio, "a b", "c d", 1 / 3), (S.partial_ratio, "abc", "xxabcxx", 1.0), (S.partial_ratio, "", "", 1.0), (S.partial_ratio, "", "a", 0.0),
        (S.jaro_winkler, "martha", "marhta", 0.9611111), (S.jaro_winkler, "dixon", "dicksonx", 0.8133333), (S.jaro_winkler, "", "", 1.0), (S.jaro_winkler, "a", "", 0.0), (S.jaro_winkler, "abcd", "abcd", 1.0),
    ],
)
def test_known_values(f, a, b, want):
    assert f(a, b) == pytest.approx(want, abs=1e-6)


def test_columns(spark):
    assert one(spark, S.token_jaccard, "", "") == 1.0
    assert one(spark, lambda a, b: S.token_jaccard(a, b, True), "", "") == 0.0
    assert one(spark, S.token_jaccard, "a b c", "b c d") == 0.5
    assert one(spark, S.levenshtein_ratio, "", "") == 1.0
    assert one(spark, S.levenshtein_ratio, "abc", "abd") == pytest.approx(2 / 3)
    row = one(spark, lambda a, b: S.measures(x=("token_sort", a, b), y=("jaro_winkler", a, b)), "b a", None)
    assert (row["x"], row["y"]) == (0.0, 0.0)


def test_partial_ratios_at_once():
    from random import Random

    from tessera.functions.similarity import partial_ratio, partial_ratios

    r = Random(1)
    text = lambda n: "".join(r.choice("ab cdé中😀") for _ in range(n))
    pairs = [(text(r.choice((0, 1, 2, 5, 9, 30, 63, 64, 65, 70))), text(r.choice((0, 1, 5, 9, 31, 63, 64, 65, 130)))) for _ in range(600)]
    pairs += [(a, a) for a, _ in pairs[:20]] + [(a[3:], a) for a, _ in pairs[:20]]
    assert partial_ratios(pairs) == [partial_ratio(a, b) for a, b in pairs]


def test_only_wanted_measures(spark, monkeypatch):
    from tessera.operators import features

    monkeypatch.setattr(features, "measures", lambda **wanted: list(wanted))
    assert "name_partial_ratio" not in features.arrow(features.FEATURES_30)
    assert features.arrow(("composite_score",)) == ["name_token_sort_ratio", "addr_token_sort_ratio"]
