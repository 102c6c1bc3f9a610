from helpers import documents
from tessera.llm import langid as L


def test_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.op3_hyperdimensional_langid(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_passes_and_undetermined(spark, monkeypatch):
    texts = {"en": "the quick brown fox jumps over the lazy dog", "de": "der schnelle braune fuchs springt über den hund", "fr": "le renard brun saute par dessus le chien paresseux"}
    docs = documents(spark, [(i, t * (1 + i), lang, "a") for i, (lang, t) in enumerate(texts.items())] + [(7, None, "en", "a"), (8, "12 34 !", "en", "a"), (9, "", None, "a")])
    learned = L.prototypes(docs)
    one = L.predict(docs, learned).orderBy("doc_id").select("doc_id", "text", "lang_pred", "score").collect()
    assert [r["lang_pred"] for r in one] == ["en", "de", "fr", "und", "und", "und"]
    assert [r["score"] for r in one[3:]] == [0.0] * 3
    monkeypatch.setattr(L, "BLOCK_LANGUAGES", 1)
    assert L.predict(docs, learned).orderBy("doc_id").select("doc_id", "text", "lang_pred", "score").collect() == one
    assert L.predict(docs, learned, keep_text=False).columns == [c for c in docs.columns if c != "text"] + ["lang_pred", "score"]


def test_pieces_add_up(monkeypatch):
    """Whole or in pieces of any size, cut within words or blanks, a text has the same vector to the bit."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("abcdé 1,  \n") for _ in range(700)), "ein langer text über viele dinge " * 50, " " * 450 + "x" + " " * 450, "1" * 333, "ab"]
    whole = L._all_vectors(texts, 64)
    for size in (1, 2, 3, 100, 699, 700, 701):
        monkeypatch.setattr(L, "PIECE_CHARS", size)
        assert (whole == L._all_vectors(texts, 64)).all()


def test_naive_vectors():
    """A text's vector from the definition, trigram by trigram."""
    import numpy as np

    text = "Ça, le Été: 42 x"
    spelt = " ça le été x "
    letter = {c: L._letters(np.array([ord(c)]), 64)[0].astype(int) for c in set(spelt)}
    want = sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(spelt, spelt[1:], spelt[2:]))
    got = L._all_vectors([text], 64)[0]
    assert np.allclose(got, want / np.sqrt((want**2).sum()))
