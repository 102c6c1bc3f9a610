"""All queries on tables with nulls, empty, long, equal and repeated texts and clashing columns, and on empty tables."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from helpers import odd_documents
from tessera.llm.queries import QUERIES

EVERY = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", EVERY)
def test_odd_and_empty(spark, tmp_path, name):
    odd = odd_documents(tmp_path / "odd")
    rows = EVERY[name](spark, odd).collect()
    n = pq.read_table(f"{odd}/{'pages' if name[:4] in ('op6_', 'op8_') else 'documents'}.parquet").num_rows
    if name.startswith("op4") or name == "pipeline":
        assert rows
    else:
        assert len(rows) == n
    empty = odd_documents(tmp_path / "empty", [])
    assert EVERY[name](spark, empty).collect() == []


def test_stages_keep_columns(spark, tmp_path):
    odd = odd_documents(tmp_path / "odd")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd).schema.simpleString() == docs.schema.simpleString(), name
