"""Small tables for the tests."""

import pyarrow as pa
import pyarrow.parquet as pq

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


ODD_TEXTS = [
    None, "", " \t\n", "x", "one two", prose(80, 1), prose(80, 1), prose(80, 2), prose(60, 3) + "\n" + prose(60, 3), prose(70, 4) + " mail a.b@c.example.org now", "###$$$ " * 60, "é ß 中文 " + prose(60, 5),
    prose(9000, 6), "a" * 5000, "\x00\x1f\x85 odd " + prose(55, 7), "tie tie", "tie tie", "!? ... --",
]


def odd_documents(folder, rows=None):
    """documents and pages with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    texts = ODD_TEXTS if rows is None else rows
    n = len(texts)
    ids = [None if i == 3 else (i if i != 17 else 16) for i in range(n)]
    table = pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None if i % 5 == 0 else "ab"[i % 2] for i in range(n)], pa.string()),
        "source": pa.array([None if i % 7 == 0 else f"s{i % 3}" for i in range(n)], pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
        **{c: pa.array(range(n), pa.int64()) for c in ("node", "class_id", "size", "target", "copies", "kept", "n_words", "score", "lang_pred", "bucket", "key", "base", "terms", "_text", "_keep", "place", "host", "first")},
    })
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.concat_tables([table, table.slice(5, 2)]) if n else table, folder / "documents.parquet")
    pages = [None, "", "<p>plain", "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>one<p>two <b>b</b>old</article><div id='comments'>bye</div>", "<div", "a < b", "<!-- x", "<p>plain"]
    pages = pages if n else []
    m = len(pages)
    pq.write_table(pa.table({
        "page_id": pa.array([None if i == 1 else i for i in range(m)], pa.int64()), "url": pa.array([None if i == 0 else f"http://h.example/{i}" for i in range(m)], pa.string()), "html": pa.array(pages, pa.string()),
        **{c: pa.array(range(m), pa.int64()) for c in ("payload", "digest", "shard", "id", "host", "places", "_text", "first")},
    }), folder / "pages.parquet")
    return str(folder)


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, "en", "a")[:2] + ((*r[2:], "en", "a")[:2] if len(r) > 2 else ("en", "a")) + (len(r[1] or ""),) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
