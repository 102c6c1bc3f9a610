import hashlib
import random
import re

from helpers import documents, prose
from tessera.llm import sanitise as S

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(digits):
    n = [int(c) for c in digits[::-1]]
    return sum(n[::2] + [d * 2 - 9 * (d > 4) for d in n[1::2]]) % 10 == 0


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 0, k == 1 and all(int(x) < 256 for x in m.group().split(".")), k == 2 and 14 <= len(d) <= 19 and passes(d), k == 3 and 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns():
    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice("aB1239@.-+ %_()1234567890.. 4111 é") for _ in range(r.randint(0, 40)))
        assert S.base_spans(t) == plain(t)
    assert S.base_spans("card 4111 1111-1111 1111.")[0][1] == 2


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "a@" * 100_000, "1." * 200_000, "+1" * 100_000, "x." * 100_000 + "@a"):
        S.base_spans(t)


def test_query(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in S.op9_information_theoretic_pii(spark, data).collect():
        want = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in S.KINDS[:4]] == [sum(x[1] == i for x in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(S.written(want).encode()).hexdigest()
        assert {*filter(None, S.written(want).split(","))} <= {*r["spans"].split(",")}


def test_terms(spark):
    """A name that goes with an address in different contexts gives it away; the words of a copied passage don't."""
    rows = [(i, f"{prose(20, i)} zorblatt writes from zed@mail.example.org {prose(20, 900 + i)}") for i in range(8)]
    rows += [(50, f"{prose(9, 50)} Zorblatt {prose(9, 51)}")]
    passage = f"{prose(12, 77)} quixle jumble@mail.example.net {prose(12, 78)}"
    rows += [(100 + i, passage.replace(" ", f" w{i} ", 1) if i % 2 else passage) for i in range(12)]
    rows += [(1000 + i, prose(40, 2000 + i)) for i in range(200)]
    docs = documents(spark, [*rows, (5000, None), (5001, "")])
    got = {r["doc_id"]: r for r in S.find(docs, ["doc_id"], with_text=True).collect()}
    found = {d: {r["text"][t["start"] : t["end"]] for t in r["terms"]} for d, r in got.items() if r["terms"]}
    assert all("zorblatt" in found[i] for i in range(8)) and found[50] == {"Zorblatt"}
    assert not any(100 <= d < 2000 for d in found)
    clean = {r["doc_id"]: r["text"] for r in S.sanitise(docs).collect()}
    assert "zed@" not in clean[0] and "[email]" in clean[0] and "orblatt" not in clean[50]
    assert clean[1005] == got[1005]["text"] and clean[5000] is None and clean[5001] == ""


def test_texts_are_cleaned_where_they_are(spark, monkeypatch):
    """Texts are neither stored nor shuffled; joined terms give the same."""
    rows = [(i, f"{prose(20, i)} zorblatt writes from m{i}@mail.example.org {prose(20, 900 + i)}") for i in range(9)]
    rows += [(1000 + i, prose(60, 2000 + i)) for i in range(200)]
    for some in (rows[9:], rows):
        docs = documents(spark, [*some, (50, None), (51, ""), (52, "Zorblatt")])
        stored, store = [], S.store
        with monkeypatch.context() as m:
            m.setattr(S, "store", lambda df, name="table": stored.append(name) or store(df, name))
            new = S.sanitise(docs)
            assert "found" not in stored and "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
            m.setattr(S, "MOST_SENT", -1)
            joined = S.sanitise(docs)
            assert "found" in stored
        assert new.columns == joined.columns == docs.columns
        got = {r["doc_id"]: r for r in new.collect()}
        assert got == {r["doc_id"]: r for r in joined.collect()} and len(got) == len(some) + 3
    assert not any("zorblatt" in (r["text"] or "").lower() or "@" in (r["text"] or "") for r in got.values())


def test_names_in_contact_blocks(spark):
    """Words of a fixed block by an address give it away in documents that differ, at a text's end too, not in near copies."""
    block = "Janeth Millerov Senior Accountant Manager Acmeon Corporation Ltdx janeth@mail.example.org"
    rows = [(i, f"{prose(60, i)} {block}") for i in range(12)] + [(50, f"{prose(40, 50)} Millerov {prose(20, 51)}")]
    copied = f"{prose(60, 77)} Quixley Brandom Deputy Registrar Townhall Bureau Office Desk quixley@mail.example.net"
    rows += [(100 + i, f"{copied} e{i}") for i in range(12)] + [(1000 + i, prose(60, 2000 + i)) for i in range(200)]
    found = {r["doc_id"]: {r["text"][t["start"] : t["end"]] for t in r["terms"]} for r in S.find(documents(spark, rows), ["doc_id"], with_text=True).collect()}
    assert all({"Janeth", "Millerov", "Acmeon", "Corporation"} <= found[i] for i in range(12)) and found[50] == {"Millerov"}
    assert not any(v for d, v in found.items() if d >= 100)


def test_cleaned():
    assert S.cleaned("call a@b.c or Bob or Al", [(5, 0, 10)], [(14, 4, 17, 0.8), (21, 4, 23, 0.99)]) == "call [email] or [term] or "


def test_words_are_found_at_any_distance():
    """Words around an entity count however many other characters are between."""
    for gap in (10, 1 << 14, (1 << 14) + 1, 200_000):
        text = f"left{' .' * gap} a@b.example{'- ' * gap}right"
        (_, words), *_ = S._near(text, S.base_spans(text))
        assert words == ["left", "right"]
    long = "x" * 300_000
    text = f"one {long} a@b.example {long} two"
    assert [w for _, w in S._near(text, S.base_spans(text))] == [["one", long, long, "two"]]


def test_terms_of_classes(spark):
    """A firm's name by different addresses of one domain gives the domain away, though each address is seen once."""
    rows = [(i, f"{prose(30, i)} Quorvex person{i}@quorvex.example.org {prose(30, 500 + i)}") for i in range(10)]
    rows += [(50, f"{prose(20, 50)} Quorvex {prose(20, 51)}")] + [(1000 + i, prose(60, 2000 + i)) for i in range(200)]
    docs = documents(spark, rows)
    found = {r["doc_id"]: {r["text"][t["start"] : t["end"]] for t in r["terms"]} for r in S.find(docs, ["doc_id"], with_text=True).collect()}
    assert all(found[i] == {"Quorvex"} for i in (*range(10), 50)) and not any(found[1000 + i] for i in range(200))


def test_disclosures_by_definition(spark):
    """Degrees against a plain count over documents."""
    import math

    texts = [f"{prose(12, i)} Zorb{i % 3} a{i % 2}@m{i % 4}.example.org {prose(9, 300 + i)}" for i in range(40)] + [prose(30, 600 + i) + " zorb1" * (i < 3) for i in range(60)]
    near, holds, entity = {}, {}, {}
    for d, t in enumerate(texts):
        for w in set(re.findall(r"[^\W_]+", t.lower())):
            holds.setdefault(S._hash(w), set()).add(d)
        for two, words in S._near(t, S.base_spans(t)):
            for e in two:
                entity.setdefault(e, set()).add(d)
                for w in words:
                    if len(w) >= S.MIN_TERM:
                        near.setdefault((e, S._hash(w)), set()).add(d)
    n, want = len(texts), {}
    for (e, w), both in near.items():
        if len(both) >= 3:
            degree = math.log(len(both) * n / (len(entity[e]) * len(holds[w]))) / math.log(n / len(entity[e]))
            if degree >= 0.5:
                want[w] = max(want.get(w, 0), degree)
    got = {r["term"]: r["disclosure"] for r in S.disclosures(documents(spark, list(enumerate(texts))), threshold=0.5).collect()}
    assert got.keys() == want.keys() and want and all(abs(got[w] - want[w]) < 1e-9 for w in want)
