"""Queries against their SQL."""

import duckdb
import pytest

from helpers import ODD_TEXTS
from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_oracle(spark, data, tmp_path, name):
    texts = [t for t in ODD_TEXTS if t is None or not t.startswith("\x00")]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "a") for i, t in enumerate(texts)]
    small = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{small}/documents.parquet")
    pages = [(i, f"http://h/{i}", t) for i, t in enumerate(["<p>a", "", None, "<p>a", "é" * 99, "<p>b"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{small}/pages.parquet")
    for folder, pattern in ((data, ""), (small, "/*.parquet")):
        con = duckdb.connect()
        for table in ("documents", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{pattern}'")
        want = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        got = QUERIES[name](spark, folder)
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
