"""Operators of the linkage engine: properties, unit cases and checks that must fail."""

import pyspark.sql.functions as F
import pytest

from tessera.operators import audit, blocking, checks, evaluate, features, links, models, ranking, retrieval
from tessera.operators.keys import prepare
from tessera.plans import fixtures
from tessera.sources import tables


@pytest.fixture(scope="module")
def part(spark, data):
    return fixtures.part(spark, data)


@pytest.fixture(scope="module")
def sides(part):
    return prepare(part.sources).cache(), prepare(part.targets).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("strategy", ["5", "8", "13", "D"])
def test_one_join_equals_union_of_joins(sides, strategy):
    s, t = sides
    every = None
    for n in blocking.STRATEGIES[strategy]:
        p = blocking.PASSES[n]
        a, b = s.alias("a"), t.alias("b")
        on = F.col("a.country") == F.col("b.country")
        for x, y, k in zip(p.left, p.right, p.least, strict=True):
            on &= (F.col(f"a.{x}") == F.col(f"b.{y}")) & (F.length(f"a.{x}") >= k)
        found = a.join(b, on).select(F.col("a.entity_id").alias("s1_id"), F.col("b.entity_id").alias("target_id"))
        every = found if every is None else every.union(found)
    assert rows(blocking.candidates(s, t, strategy)) == rows(every.groupBy("s1_id", "target_id").agg(F.count("*").alias("pass_count")))


def test_depths_of_compared_strategies():
    assert {n: (len(blocking.STRATEGIES[p]), k) for n, (p, k) in blocking.DEPTHS.items()} == {"A": (8, 25), "B": (8, 50), "C": (8, 100), "D": (12, 50), "E": (12, 50), "F": (12, 50)}


def test_partitions_dont_matter(sides):
    s, t = sides
    assert rows(blocking.candidates(s.repartition(7), t.repartition(2))) == rows(blocking.candidates(s, t))


def test_nulls_and_empty_tables(spark):
    records = spark.createDataFrame([("S1-1", None, None, None), ("S2-1", None, None, None), ("S1-2", "Acme Corp", None, "X"), ("S3-2", "acme corp", "", "X")], tables.RECORDS)
    p = prepare(records)
    s, t = p.filter("entity_id like 'S1-%'"), p.filter("entity_id not like 'S1-%'")
    top = ranking.top_k(blocking.candidates(s, t), s, t)
    assert [(r["s1_id"], r["target_id"], r["pass_count"], r["jaccard_score"]) for r in top.collect()] == [("S1-2", "S3-2", 1, 1.0)]
    none = p.filter("false")
    assert blocking.candidates(none, t).count() == retrieval.ngram_candidates(none, t).count() == retrieval.token_votes(s, none).count() == 0
    f = features.features(top, features.FEATURES_30).first().asDict()
    assert f["f_name_exact_norm"] == 1.0 and f["f_addr_num_overlap"] == 0.5 and f["f_s1_addr_missing"] == 1.0 and f["f_name_levenshtein_ratio"] == 1.0


def test_recall_grows_with_depth(part, sides):
    s, t = sides
    r = evaluate.recall_at(ranking.top_k(blocking.candidates(s, t), s, t, 50), part.links, (1, 5, 10, 50)).first()
    assert r["hits_1"] <= r["hits_5"] <= r["hits_10"] <= r["hits_50"] <= r["links"]


@pytest.mark.parametrize("true, made, want", [((), (), 1.0), ((), ("x",), 0.0), (("m",), ("m",), 1.0), (("m",), ("n",), 0.0), (("m", "n"), ("m",), 0.8333), (("m", "n"), ("m", "n", "x"), 0.7143), (("m",), (), 0.0)])
def test_f_half(spark, true, made, want):
    pairs = lambda ts: spark.createDataFrame([("a", t) for t in ts], "s1_id string, target_id string")
    got = evaluate.entity_scores(pairs(made), pairs(true), spark.createDataFrame([("a",)], "s1_id string")).first()
    assert got["f"] == pytest.approx(want, abs=1e-4)


def test_grid_equals_single_thresholds(part, sides):
    s, t = sides
    top = ranking.top_k(blocking.candidates(s, t), s, t)
    scored = top.select("s1_id", "target_id", F.col("jaccard_score").alias("probability")).cache()
    ids = s.select(F.col("entity_id").alias("s1_id"))
    grid = {r["threshold"]: r for r in evaluate.threshold_grid(scored, part.links, ids).collect()}
    for at in (0.3, 0.6, 0.95):
        one = evaluate.summarise(evaluate.entity_scores(scored.filter(F.col("probability") >= at).drop("probability"), part.links, ids)).first()
        assert [round(grid[at][c], 12) for c in one.asDict()] == [round(one[c], 12) for c in one.asDict()]


def test_allocation():
    assert links.allocate({"a": 10, "b": 0, "c": 20, "d": 30}, 12) == {"a": 2, "c": 4, "d": 6}
    assert links.allocate({"a": 1, "b": 1}, 9) == {"a": 1, "b": 1}
    assert links.allocate({}, 5) == {}


def test_split_and_sample(part):
    s = ranking.split(links.with_truth(prepare(part.sources), part.truth))
    assert checks.require(checks.split_leaks(s)) == {"in_both": 0, "several": 0, "in_neither": 0}
    assert rows(ranking.sample(part.records, 17)) == rows(ranking.sample(part.records.repartition(9), 17))
    assert ranking.sample(part.records, 10**6).count() == part.records.count()


def test_ranks_and_first_rows(spark):
    """Against sorting everything in one place, with strata and keys that are null and ties."""
    df = spark.createDataFrame([(f"e{i}", [None, "a", "b"][i % 3], i % 7) for i in range(300)], "entity_id string, s string, x int")
    got = {r["entity_id"]: (r["_rank"], r["_of"]) for r in ranking.digest_rank(df.repartition(5), [F.col("s")], F.md5("entity_id")).collect()}
    import hashlib

    for s in (None, "a", "b"):
        order = sorted((r["entity_id"] for r in df.filter(F.col("s").eqNullSafe(F.lit(s))).collect()), key=lambda e: hashlib.md5(e.encode()).hexdigest())
        assert [got[e] for e in order] == [(i + 1, len(order)) for i in range(len(order))]
    whole = sorted((r["x"], r["entity_id"]) for r in df.collect())
    for n in (0, 1, 42, 43, 44, 299, 300, 301):
        assert sorted((r["x"], r["entity_id"]) for r in ranking.first_rows(df, n, F.col("x"), ["x", "entity_id"]).collect()) == whole[:n]


def test_checks_raise(spark, part, sides):
    s, t = sides
    with pytest.raises(ValueError, match="duplicates"):
        checks.require(checks.duplicate_ids(part.records.union(part.records.limit(1))))
    bad = spark.createDataFrame([("S1-3", "S1-6"), ("S1-3", "S2-nope"), ("S1-3", "S2-nope")], "s1_id string, target_id string")
    with pytest.raises(ValueError, match="to_sources.*missing_s2.*twice"):
        checks.require(checks.truth_faults(bad, part.sources, part.targets))
    pairs = blocking.candidates(s, t)
    top = ranking.top_k(pairs, s, t, 3)
    checks.require(checks.topk_faults(top, pairs, 3))
    with pytest.raises(ValueError, match="below"):
        checks.require(checks.topk_faults(top, pairs, 0))


def test_links_round_trip(part):
    assert rows(links.explode_links(part.truth)) == rows(part.links)
    assert rows(links.explode_links(part.truth.select("source1_entity_id", F.concat_ws(" , ", "matched_entity_ids", F.lit("")).alias("matched_entity_ids")))) == rows(part.links)


def test_miss_categories(spark):
    cases = [("", "", "x", "y", "", "both_names_missing"), ("a", "", "x", "y", "", "one_name_missing"), ("abcd", "efgh", "x", "", "", "no_name_overlap_no_address"), ("abcd", "efgh", "x", "y", "", "no_name_overlap_address_only"), ("ab c", "ab d", "x", "y", "", "only_short_tokens_shared"), ("abcd", "abcd", "", "y", "", "name_overlap_no_address"), ("abcd", "abcd", "x", "y", "", "other"), ("a", "b", "x", "y", "आ", "indic_or_cjk_target_name")]
    df = spark.createDataFrame(cases, "s1_norm_name string, t_norm_name string, s1_norm_addr string, t_norm_addr string, t_raw_name string, want string")
    assert df.filter(evaluate.miss_category() != F.col("want")).count() == 0


def test_prefix_and_rules(sides):
    s, t = sides
    got = rows(blocking.prefix_join(s, t, "p1", "norm_name", 4))
    want = [(a["entity_id"], b["entity_id"]) for a in s.collect() for b in t.collect() if a["country"] == b["country"] and (len(a["p1"]) >= 4 and b["norm_name"].startswith(a["p1"]) or len(b["p1"]) >= 4 and a["norm_name"].startswith(b["p1"]))]
    assert got == sorted(want)


def test_short_words_are_one_gram(spark):
    got = spark.createDataFrame([("a bc def",)], "t string").select(retrieval.grams(F.col("t"))).first()[0]
    assert sorted(got) == sorted([" a ", " bc", "bc ", " bc ", " de", "def", "ef ", " def", "def "])


def test_tables(spark, part, tmp_path):
    names = spark.createDataFrame([("S1-1", 'raw "quoted" name', None, "X"), ("S1-2", "b", "", "X")], tables.RECORDS)
    tables.write_tsv(names, str(tmp_path / "t"))
    back = tables.read_tsv(spark, str(tmp_path / "t"))
    assert back.filter("entity_id = 'S1-1'").first()["business_name"] == 'raw "quoted" name'
    (tmp_path / "short.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tx\nS1-2\ta\tb\tc\n")
    assert tables.read_tsv(spark, str(tmp_path / "short.tsv")).count() == 2
    assert [r["entity_id"] for r in tables.read_tsv(spark, str(tmp_path / "short.tsv"), lenient=True).collect()] == ["S1-2"]
    with pytest.raises(FileNotFoundError, match="b.tsv"):
        tables.locate(str(tmp_path), ["short.tsv", "b.tsv"])
    tables.write_json({"a": 1}, str(tmp_path / "r.json"))
    tables.write_markdown("Report", {"one": {"x": 1}, "two": [{"a": 1, "b": 2}]}, str(tmp_path / "r.md"))
    assert "| x | 1 |" in (tmp_path / "r.md").read_text() and "| a | b |" in (tmp_path / "r.md").read_text()
    assert tables.preview(names, 1)[0] == 2 and tables.describe(names)[0] == ("entity_id", "string")


def test_noise_kinds(spark):
    pairs = spark.createDataFrame([("1", "2", "Aviva Group Private Limited", "Aviva Group", "5 Main Rd", "5 Main Road"), ("3", "4", "Lotus Blue It", "It Lotus Blue", "404 Locksley", "404-406 Locksley"), ("5", "6", "Garcia System", "garcia.com", "near x", None)], "s1_id string, target_id string, s1_name string, t_name string, s1_addr string, t_addr string")
    got = {r["s1_id"]: r.asDict() for r in audit.pair_noise(pairs).collect()}
    assert got["1"]["legal_suffix_variations"] and got["1"]["address_abbreviations"] and got["1"]["name_abbreviations"]
    assert got["3"]["word_order_changes"] and got["3"]["number_formats"] and got["3"]["name_sort"] == 1.0
    assert got["5"]["domain_as_name"] and got["5"]["landmark_addresses"] and got["5"]["missing_address_components"]


def test_models(spark, tmp_path):
    rows_ = [(f"s{i}", f"t{i}", float(i % 10) / 10, float(i % 3), int(i % 10 > 5)) for i in range(200)]
    matrix = spark.createDataFrame(rows_, "s1_id string, target_id string, f_a double, f_b double, label int")
    for fit in (models.logistic, lambda m: models.boosted(m, 5), lambda m: models.forest(m, 5)):
        model = fit(matrix)
        scored = models.predict(model, matrix)
        assert models.curves(scored)["roc_auc"] > 0.99
        assert models.importances(model, ["f_a", "f_b"])[0][0] == "f_a"
    models.save(model, str(tmp_path / "m"))
    again = models.predict(models.load(str(tmp_path / "m")), matrix)
    assert rows(again) == rows(scored)
    assert models.blend(scored, scored, 0.25).count() == 200
    assert models.winner({"a": 1.0, "b": 1.0}, "b") == "b" and models.winner({"b": 2.0, "a": 1.0}) == "b"
