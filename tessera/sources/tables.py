"""Delimited record files in, results and reports out."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str = RECORDS, lenient: bool = False, quoted: bool = False) -> DataFrame:
    """A tab-separated file with a header and the given schema. Quotes are characters like others unless `quoted`.

    Short rows are filled with nulls, or dropped if `lenient`.
    """
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED" if lenient else "PERMISSIVE")
    return (reader if quoted else reader.option("quote", "")).csv(path)


def write_tsv(df: DataFrame, path: str, quoted: bool = False) -> None:
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("escape", "")
    (writer if quoted else writer.option("quote", "")).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def union(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def preview(df: DataFrame, n: int = 3) -> tuple[int, list]:
    """The number of rows and the first n by id."""
    return df.count(), df.orderBy(df.columns[0]).limit(n).collect()


def describe(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def matches(sources: DataFrame, ranked: DataFrame, by: str | None = "entity_id", order: str = "candidate_rank", out: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, out) for every source, in the order of `by` (None: any): its targets by `order`, without repeats, joined by commas."""
    lists = ranked.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col("target_id")))).alias("x"))
    text = F.array_join(F.array_distinct(F.transform("x", lambda s: s["target_id"])), ",")
    joined = sources.join(lists, sources["entity_id"] == lists["s1_id"], "left")
    return (joined if by is None else joined.orderBy(by)).select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(text, F.lit("")).alias(out))


def faults(result: DataFrame, sources: DataFrame, targets: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row: sources missing from a result, unknown sources, sources that occur twice, unknown targets, targets that occur twice in a row."""
    ids = result.select("source1_entity_id")
    known = sources.select(F.col("entity_id").alias("source1_entity_id"))
    links = result.select("source1_entity_id", F.explode(F.split(column, ",")).alias("target_id")).filter("target_id <> ''")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(known.join(ids, "source1_entity_id", "left_anti"), "missing"), count(ids.join(known, "source1_entity_id", "left_anti"), "unknown"),
        count(ids.groupBy("source1_entity_id").count().filter("count > 1"), "twice"), count(links.join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti"), "unknown_targets"),
        count(links.groupBy("source1_entity_id", "target_id").count().filter("count > 1"), "repeated_targets"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def write_json(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)


def write_markdown(title: str, sections: dict[str, dict | list[dict]], path: str) -> None:
    """A report with a table for each section: of names and values, or of rows."""
    lines = [f"# {title}", ""]
    for name, body in sections.items():
        rows = [{"name": k, "value": v} for k, v in body.items()] if isinstance(body, dict) else body
        lines += [f"## {name}", ""]
        if rows:
            heads = list(rows[0])
            lines += ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *("| " + " | ".join(str(r[h]) for h in heads) + " |" for r in rows)]
        lines.append("")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def locate(folder: str, names: list[str]) -> dict[str, str]:
    """The paths of files somewhere below a folder, in its zip archives too (these are unpacked beside them). Raises if one is missing."""
    for base, _, files in os.walk(folder):
        for f in files:
            if f.endswith(".zip") and not os.path.isdir(os.path.join(base, f[:-4])):
                with zipfile.ZipFile(os.path.join(base, f)) as z:
                    z.extractall(os.path.join(base, f[:-4]))
    found = {f: os.path.join(base, f) for base, _, files in sorted(os.walk(folder)) for f in files if f in names}
    missing = sorted(set(names) - set(found))
    if missing:
        raise FileNotFoundError(f"not below {folder}: {', '.join(missing)}")
    return found
