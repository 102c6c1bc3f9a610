"""SQL for DuckDB that says what some of the queries compute, by brute force where the operators are clever."""

from __future__ import annotations

from tessera.llm import minhash_join, quality

SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format("lower(coalesce(text, ''))")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {minhash_join.WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {minhash_join.WORDS - 2}), lambda i: array_to_string(w[i:i + {minhash_join.WORDS - 1}], ' ')) END) AS gram FROM w),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c >= {minhash_join.THRESHOLD} * (x.n + y.n - c) - 1e-9),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY 1)
SELECT w.doc_id, class_id, (SELECT count(*) FROM links WHERE a = w.doc_id) AS n_links, CASE WHEN len(w.w) = 0 THEN 1 ELSE (SELECT count(*) FROM w o WHERE o.w = w.w) END AS n_copies
FROM w JOIN class ON w.doc_id = class.doc_id"""


_HALF, _LOW = quality.EXACT // 2, quality.EXACT.bit_length() - 1


def _value(b: str) -> str:
    return f"(CASE WHEN {b} < {quality.EXACT} THEN {b} ELSE ((({b}) - {quality.EXACT}) % {_HALF} + {_HALF}) * pow(2, floor((({b}) - {quality.EXACT}) / {_HALF}) + 1) END)::bigint"


def _quartiles(name: str, keys: str) -> str:
    by, on = (f"{keys}, ", f"{keys}, rate") if keys else ("", "rate")
    at = lambda q: _value(f"(min(bin) FILTER (upto >= ceil(texts * {q})))")
    return f"""{name}_runs AS (SELECT {by}rate, bin, sum(n) OVER (PARTITION BY {on} ORDER BY bin)::bigint AS upto, sum(n) OVER (PARTITION BY {on})::bigint AS texts FROM (SELECT {by}rate, bin, sum(n) AS n FROM sketch GROUP BY ALL)),
{name}_q AS (SELECT {by}rate, texts, {at(0.25)} AS low, {at(0.5)} AS mid, {at(0.75)} AS high FROM {name}_runs GROUP BY {by}rate, texts),
{name} AS (SELECT {by}rate, texts, low, mid, high - mid AS up, mid - low AS down FROM {name}_q)"""


def _lean(a: str, b: str) -> str:
    return ", ".join(f"({a}.{c} * {a}.texts + {quality.PRIOR} * {b}.{c}) / ({a}.texts + {quality.PRIOR})::double AS {c}" for c in ("low", "mid", "up", "down"))


def _spread(k: str, side: str) -> str:
    return f"greatest({1000.0 * quality.GRAIN[k]}::double / greatest(low_{quality.RATES[k][1]}, 1.0::double), {side}_{k})"


_rate = lambda k: "coalesce(floor(1000 * {} / nullif({}, 0)), 0)::bigint".format(*quality.RATES[k])
_verdict = " AND ".join([f"coalesce(r_{k} >= least_{k}, true)" for k in quality.LOWER] + [f"coalesce(r_{k} <= most_{k}, true)" for k in quality.RATES])
_wide = ", ".join(f"max({c}) FILTER (rate = '{k}') AS {c}_{k}" for k in (*quality.RATES, *quality.SIZES) for c in ("low", "mid", "up", "down"))
_limits = ", ".join([f"mid_{k} - {quality.FENCE} * {_spread(k, 'down')} AS least_{k}" for k in quality.LOWER] + [f"mid_{k} + {quality.FENCE} * {_spread(k, 'up')} AS most_{k}" for k in quality.RATES])
_values = ", ".join([f"{{'rate': '{k}', 'v': r_{k}}}" for k in quality.RATES] + [f"{{'rate': '{k}', 'v': {k}::bigint}}" for k in quality.SIZES])

QUALITY = rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {SPLIT.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, sum(c) AS n_lines, sum(c - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY 1),
windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(j) GROUP BY 1),
counts AS (SELECT t.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0)::bigint AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
rated AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"{_rate(k)} AS r_{k}" for k in quality.RATES)} FROM counts),
long AS (SELECT lang, source, unnest([{_values}]) AS x FROM rated WHERE NOT base_failed),
sketch AS (SELECT lang, source, x.rate AS rate, CASE WHEN x.v < {quality.EXACT} THEN x.v ELSE {_HALF} * (floor(log2(x.v)) - {_LOW - 1}) + floor(x.v / pow(2, floor(log2(x.v)) - {_LOW - 1})) END::bigint AS bin, count(*) AS n FROM long GROUP BY ALL),
{_quartiles("own", "lang, source")},
{_quartiles("tongue", "lang")},
{_quartiles("whole", "")},
leaning AS (SELECT l.lang, l.rate, {_lean("l", "e")}, e.up AS every_up, e.down AS every_down FROM tongue l JOIN whole e ON l.rate = e.rate),
chosen AS (SELECT lang, source, rate, low, mid, least(up, most_up) AS up, least(down, most_down) AS down FROM (SELECT o.lang, o.source, o.rate, {_lean("o", "l")}, least(l.up, every_up) AS most_up, least(l.down, every_down) AS most_down
  FROM own o JOIN leaning l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate)),
limits AS (SELECT lang, source, {_limits} FROM (SELECT lang, source, {_wide} FROM chosen GROUP BY lang, source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict} AS kept
FROM rated r LEFT JOIN limits m ON r.lang IS NOT DISTINCT FROM m.lang AND r.source IS NOT DISTINCT FROM m.source"""

_value_of = "list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, 5 * i + j + 1, 1) = '1' THEN 1 << (4 - j)::int ELSE 0 END))::int"
_bits = "array_to_string(list_transform(string_split(sha1(payload), ''), lambda d: array_to_string(list_transform(range(4), lambda j: ((instr('0123456789abcdef', d) - 1) >> (3 - j)::int) & 1), '')), '')"
ARCHIVE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, {_bits} AS bits FROM p)
SELECT page_id, strlen(payload) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_value_of}, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM b"""

ORACLE_SQL = {"op6_sharded_warc": ARCHIVE, "op5_adaptive_quality": QUALITY, "op10_minhash_jaccard_join": NEAR_DUPLICATES}
