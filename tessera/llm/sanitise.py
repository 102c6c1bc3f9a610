"""Personal data by patterns, and information-theoretic sanitisation of the terms that give it away.

Entities are what the patterns find: mail and IP addresses, card and phone numbers, told apart by their characters
without separators, and their classes: a mail address's domain, an IP address's first two parts, a card's issuer, a
phone number's country and area. So a term can give away whose address it is though each address is seen once. Terms
are words of letters and digits. Over the whole corpus it counts in how many documents an
entity occurs, a term occurs, and both occur within WINDOW words. A term discloses an entity to the degree
PMI(entity; term) / IC(entity): 1 if the term never occurs without the entity, 0 if it tells nothing. Terms of at
least DISCLOSURE for some entity, seen with it in at least MIN_CONTEXTS different documents, are generalised wherever
they occur, and removed from REMOVAL up. In documents that are copies, with edits or without, all words go with the
entity alike and none gives it away. So documents are told apart by sketches, SKETCH least hashes of their runs of
three words: by most of these there must be MIN_CONTEXTS different ones, and one to COPIES documents. A block of fixed
words by an entity (as in signatures) hides none of its words if the rest of the documents differ.

Terms reach the passes over the texts as a filter of fixed size; what it lets through is joined exactly. Entities and
terms are told apart by 64-bit hashes.

Edge cases: a null or empty text has no spans; rows that repeat count as documents of their own but share
their sketch; where no document has an entity there are no terms; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import documents, store, tidy

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 8
"""Words on each side of an entity that co-occur with it."""
MIN_CONTEXTS = 3
SKETCH = 5
COPIES = 3
"""Documents to a different sketch, above which most of them are taken for copies."""
DISCLOSURE = 0.75
REMOVAL = 0.95
MIN_TERM = 3
"""Characters of the shortest term."""
ISSUER_DIGITS = 6
AREA_DIGITS = 4
"""Digits of a card number, and of a phone number, that name its class."""
FILTER_BITS = 24
KNOWN_WORDS = 200_000
FLUSH = 500_000
MOST_SENT = 1 << 20
"""Terms sent to the texts at most (16 MB)."""

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_chain = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_digits = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_plus = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"[^\W_]+")
_local_set = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds, in time that grows with the text only."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local_set:
            start -= 1
        end = at + 1
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            free = end = m.end()
        elif start < at:
            free = at
        at = text.find("@", end)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """What [0-9]+(\\.[0-9]+){3} finds with no part above 255, in time that grows with the text only."""
    if text.count(".") < 3:
        return
    for m in _chain.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start and kind."""
    spans = [(s, 0, e) for s, e in emails(text)]
    spans += [(s, 1, e) for s, e in addresses(text)]
    for m in _digits.finditer(text):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _plus.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _hash(data: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def entities(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """The hashes of a span's entity and of its class."""
    start, kind, end = span
    if kind == 0:
        value = text[start:end].lower()
        wide = value.rpartition("@")[2]
    elif kind == 1:
        value = text[start:end]
        wide = ".".join(value.split(".")[:2])
    else:
        value = re.sub(r"[^0-9]", "", text[start:end])
        wide = value[: ISSUER_DIGITS if kind == 2 else AREA_DIGITS]
    return _hash(f"{KINDS[kind]}:{value}"), _hash(f"{KINDS[kind]} class:{wide}")


def terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-case word) of a text's terms outside its spans, which are sorted by start."""
    i, reach = 0, -1
    for m in _word.finditer(text):
        s, e = m.span()
        while i < len(spans) and spans[i][0] < e:
            reach = max(reach, spans[i][2])
            i += 1
        if s >= reach and e - s >= MIN_TERM:
            yield s, e, m.group().lower()


def _near(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """(its entities, words around it) of each span; reads no further than the words, however far they are."""
    for span in spans:
        left, right, size = [], [], 64
        while len(left) < WINDOW:
            low = max(0, span[0] - size)
            left = [m.group().lower() for m in _word.finditer(text, low, span[0]) if m.start() > low or not low]
            if not low:
                break
            size *= 2
        for m in _word.finditer(text, span[2]):
            right.append(m.group().lower())
            if len(right) == WINDOW:
                break
        yield entities(text, span), left[-WINDOW:] + right


def sketch(words: list[str], known: dict[str, int]) -> tuple[int, ...]:
    """For each of SKETCH hash functions, the least hash of a text's runs of three words; of fewer words, of all of them."""
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    runs = ids[:-2] * odd[0] + ids[1:-1] * odd[1] + ids[2:] * odd[2] if len(ids) > 2 else np.array([_hash(" ".join(words)) & ((1 << 64) - 1)], np.uint64)
    out = []
    for i in range(SKETCH):
        x = (runs ^ (runs >> np.uint64(29))) + np.uint64(0x632BE59BD9B4E019 * (i + 1) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(int((x ^ (x >> np.uint64(31))).min().astype(np.int64)))
    return tuple(out)


class _Hashes(dict):
    """Of a word, its hash without sign."""

    def __missing__(self, word: str) -> int:
        self[word] = h = _hash(word) & ((1 << 64) - 1)
        return h


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, s0, s1, ..., docs): documents by entity (the others null), and by entity, term and sketch."""
    found, known = Counter(), _Hashes()
    names = ["entity", "term", *(f"s{i}" for i in range(SKETCH)), "docs"]

    def rows() -> pa.RecordBatch:
        keys = list(found)
        out = pa.record_batch([pa.array([k[i] for k in keys], pa.int64()) for i in range(2 + SKETCH)] + [pa.array([found[k] for k in keys], pa.int64())], names=names)
        found.clear()
        return out

    for b in tidy(batches):
        for t in b.column(0):
            text = t.as_py() or ""
            spans = base_spans(text)
            if not spans:
                continue
            if len(known) > KNOWN_WORDS:
                known.clear()
            mine, drawn, none = set(), sketch(_word.findall(text.lower()), known), (None,) * SKETCH
            for two, words in _near(text, spans):
                around = [_hash(w) for w in words if len(w) >= MIN_TERM]
                for e in two:
                    mine.add((e, None, *none))
                    mine.update((e, w, *drawn) for w in around)
            found.update(mine)
        if len(found) > FLUSH:
            yield rows()
    yield rows()


class _Filter(dict):
    """Of a lower-case word, its hash if the filter may hold it, else None."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> int | None:
        h = _hash(word)
        place = (h & ((1 << 64) - 1)) >> (64 - FILTER_BITS)
        self[word] = out = h if int(self.bits[place >> 6]) >> (place & 63) & 1 else None
        return out


def term_filter(found: DataFrame) -> np.ndarray | None:
    """A bit set of fixed size of the hashes `term`; null if there are none."""
    place = F.shiftrightunsigned("term", 64 - FILTER_BITS)
    words = found.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - FILTER_BITS}) % 64 as int))")).alias("v")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for w, v in words:
        bits[w] = v & ((1 << 64) - 1)
    return bits if words else None


def _frequencies(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(term, docs) of the filter's terms."""
    known, found = _Filter(bits), Counter()
    for b in tidy(batches):
        if len(known) > KNOWN_WORDS:
            known.clear()
        for t in b.column(0):
            text = t.as_py() or ""
            found.update({h for h in map(known.__getitem__, set(_word.findall(text.lower()))) if h is not None})
    yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["term", "docs"])


def disclosures(docs: DataFrame, text: str = "text", threshold: float = DISCLOSURE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(term, disclosure): the terms at or above the threshold for some entity, by hash, with their highest degree."""
    texts = docs.select(text)
    n = texts.count()
    drawn = [f"s{i}" for i in range(SKETCH)]
    seen = texts.mapInArrow(_pairs, f"entity long, term long, {', '.join(f'{s} long' for s in drawn)}, docs long")
    seen = store(seen.groupBy("entity", "term", *drawn).agg(F.sum("docs").alias("docs")), "cooccurrence")
    entities = seen.filter("term is null").select("entity", F.col("docs").alias("entity_docs"))
    joint = seen.filter("term is not null").groupBy("entity", "term").agg(F.sum("docs").alias("both"), F.sort_array(F.array(*[F.count_distinct(s) for s in drawn]))[SKETCH // 2].alias("contexts"))
    joint = store(joint.filter((F.col("contexts") >= min_contexts) & (COPIES * F.col("contexts") >= F.col("both"))).join(entities, "entity"), "joint")
    bits = term_filter(joint.select("term"))
    if bits is None:
        return joint.select("term", F.lit(0.0).alias("disclosure"))
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    frequency = texts.mapInArrow(lambda it: _frequencies(it, sent.value), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("term_docs"))
    both = F.least("both", "entity_docs", "term_docs")
    pmi = F.log(both * n / (F.col("entity_docs") * F.col("term_docs")))
    degree = F.coalesce(F.try_divide(pmi, F.log(n / F.col("entity_docs"))), F.lit(0.0))
    telling = joint.join(frequency, "term").select("term", degree.alias("degree")).filter(F.col("degree") >= threshold)
    return store(telling.groupBy("term").agg(F.max("degree").alias("disclosure")), "disclosures")


def _find(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None, text: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    known, uid = _Filter(bits if bits is not None else np.zeros(0, np.uint64)), TaskContext.get().partitionId() << 33
    for b in tidy(batches):
        if len(known) > KNOWN_WORDS:
            known.clear()
        base, hits = [], []
        for t in b.column(text):
            value = t.as_py() or ""
            spans = base_spans(value)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            mine = [] if bits is None else [{"term": h, "start": s, "end": e} for s, e, w in terms(value, spans) if (h := known[w]) is not None]
            hits.append(mine)
        n = b.num_rows
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        hit = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        kept = [i for i in range(b.num_columns) if with_text or i != text]
        yield pa.record_batch([pa.array(np.arange(uid, uid + n)), *(b.column(i) for i in kept), pa.array(base, span), pa.array(hits, hit)], names=["_row", *(b.schema.names[i] for i in kept), "base", "hits"])
        uid += n


def find(docs: DataFrame, keep: list[str], text: str = "text", threshold: float = DISCLOSURE, min_contexts: int = MIN_CONTEXTS, with_text: bool = False) -> DataFrame:
    """The columns `keep` of docs (and its text, if asked for) with base and terms.

    These are arrays of (start, kind, end) and of (start, kind, end, disclosure).
    """
    revealing = disclosures(docs, text, threshold, min_contexts)
    return _find_terms(docs, keep, text, revealing, term_filter(revealing), with_text)


def _find_terms(docs: DataFrame, keep: list[str], text: str, revealing: DataFrame, bits: np.ndarray | None, with_text: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(*keep, text)
    span, hit = "array<struct<start:long,kind:int,end:long>>", "array<struct<term:long,start:long,end:long>>"
    copied = rows.schema.fields if with_text else rows.schema.fields[:-1]
    fields = T.StructType([T.StructField("_row", T.LongType()), *copied, T.StructField("base", T._parse_datatype_string(span)), T.StructField("hits", T._parse_datatype_string(hit))])
    found = store(rows.mapInArrow(lambda it: _find(it, sent.value, len(keep), with_text), fields), "found")
    hits = found.select("_row", F.explode("hits").alias("h")).select("_row", "h.*").join(revealing, "term")
    span = F.struct(F.col("start"), F.lit(KINDS.index("term")).alias("kind"), F.col("end"), F.col("disclosure"))
    hits = hits.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("terms"))
    return found.join(hits, "_row", "left").select(*keep, *[text] * with_text, "base", F.coalesce("terms", F.array().cast("array<struct<start:long,kind:int,end:long,disclosure:double>>")).alias("terms"))


def cleaned(text: str, base: list[tuple[int, int, int]], revealing: list[tuple[int, int, int, float]], removal: float = REMOVAL) -> str:
    """The text with entities replaced by their kind, terms by a general word, or by nothing from `removal` up."""
    spans = sorted([(s, e, f"[{KINDS[k]}]") for s, k, e in base] + [(s, e, "" if d >= removal else "[term]") for s, _, e, d in revealing])
    out, at = [], 0
    for s, e, mark in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tidy(batches):
        new = []
        for t, base, revealing in zip(b.column(1), b.column(2), b.column(3), strict=True):
            value, base, revealing = t.as_py(), base.as_py(), revealing.as_py()
            if value is not None and (base or revealing):
                value = cleaned(value, [(x["start"], x["kind"], x["end"]) for x in base], [(x["start"], x["kind"], x["end"], x["disclosure"]) for x in revealing])
            new.append(value)
        yield pa.record_batch([b.column(0), pa.array(new, pa.string())], names=b.schema.names[:2])


class _Degrees(dict):
    """Of a lower-case word, its disclosure if it is one of the terms, else None."""

    def __init__(self, hashes: np.ndarray, degrees: np.ndarray):
        super().__init__()
        self.hashes, self.degrees = hashes, degrees

    def __missing__(self, word: str) -> float | None:
        h = _hash(word)
        i = int(np.searchsorted(self.hashes, h))
        self[word] = out = float(self.degrees[i]) if i < len(self.hashes) and self.hashes[i] == h else None
        return out


def _clean_at_once(batches: Iterator[pa.RecordBatch], hashes: np.ndarray, degrees: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Finds and cleans in one pass, given the terms by ascending hash."""
    known = _Degrees(hashes, degrees)
    for b in tidy(batches):
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = []
        for t in b.column(1):
            value = t.as_py()
            if value:
                base = base_spans(value)
                revealing = [(s, KINDS.index("term"), e, d) for s, e, w in terms(value, base) if (d := known[w]) is not None] if len(hashes) else []
                value = cleaned(value, base, revealing)
            new.append(value)
        yield pa.record_batch([b.column(0), pa.array(new, pa.string())], names=b.schema.names)


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its texts sanitised; the other columns stay as they are.

    Up to MOST_SENT terms are sent to the texts, which then are neither stored nor shuffled; more are joined.
    """
    rest = [c for c in docs.columns if c != text]
    named = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_keep"), F.col(text).alias("_text"))
    revealing = disclosures(named, "_text")
    if revealing.count() <= MOST_SENT:
        table = revealing.toArrow().sort_by("term")
        sent = docs.sparkSession.sparkContext.broadcast((table["term"].to_numpy(), table["disclosure"].to_numpy()))
        new = named.mapInArrow(lambda it: _clean_at_once(it, *sent.value), named.schema)
    else:
        found = _find_terms(named, ["_keep"], "_text", revealing, term_filter(revealing), with_text=True)
        new = found.mapInArrow(_clean, T.StructType(found.schema.fields[:2]))
    return new.select(*[F.col("_text").alias(c) if c == text else F.col("_keep")[c].alias(c) for c in docs.columns])


def op9_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), ["doc_id"])
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    plain = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    many = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[many(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", plain))).alias("spans"),
    )
