"""SQL for DuckDB that says what the queries compute, written the plain way: one join for each pass, macros spelled out."""

from __future__ import annotations

from tessera.functions.normalise import AUDIT_LEGAL, AUDIT_STREET, DOMAINS, LEGAL_PAIRS, LEGAL_WORDS
from tessera.operators.blocking import PASSES
from tessera.plans.fixtures import DOCS_SQL, PART_SQL

LEGAL = "|".join(rf"{a}\s+{b}" for a, b in LEGAL_PAIRS) + "|" + LEGAL_WORDS


def norm(c: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), 'https?://(?:www\.)?|www\.', '', 'g'), '\.(?:{DOMAINS})\b', ' ', 'g'), '[^\w\s]', ' ', 'g')))"


def core(c: str) -> str:
    return rf"trim(regexp_replace({norm(c)}, '\b(?:{LEGAL})\b', ' ', 'g'))"


def compact(c: str) -> str:
    return rf"regexp_replace({norm(c)}, '\s+', '', 'g')"


def addr(c: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')))"


def token(c: str, n: int) -> str:
    return f"coalesce(string_split(trim({c}), ' ')[{n}], '')"


def audit_norm(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace(coalesce({c}, ''), '[^a-zA-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def audit_core(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({audit_norm(c)}, '\b({DOMAINS})\b', '', 'g'), '\b({AUDIT_LEGAL})\b', '', 'g'))"


def audit_addr(c: str) -> str:
    return rf"trim(regexp_replace({audit_norm(c)}, '\b({AUDIT_STREET})\b', '', 'g'))"


PREP = rf"""prep AS (
  SELECT entity_id, coalesce(country, '') AS country, business_name AS raw_name, business_address AS raw_addr, {norm("business_name")} AS norm_name, {core("business_name")} AS core_name, {addr("business_address")} AS norm_addr,
    {token(core("business_name"), 1)} AS p1, {token(core("business_name"), 2)} AS p2, {token(core("business_name"), 3)} AS p3, left({compact("business_name")}, 4) AS cmp4, left({compact("business_name")}, 5) AS cmp5,
    regexp_extract({addr("business_address")}, '\b(\d{{3,}})\b', 1) AS postal, regexp_extract({addr("business_address")}, '^(\d+)', 1) AS door, {token(addr("business_address"), 1)} AS a1, {token(addr("business_address"), 2)} AS a2
  FROM rec)"""
AUDIT_PREP = rf"""prep AS (
  SELECT entity_id, coalesce(country, '') AS country, business_name AS raw_name, business_address AS raw_addr, {audit_norm("business_name")} AS norm_name, {audit_core("business_name")} AS core_name, {audit_norm("business_address")} AS norm_addr,
    string_split({audit_core("business_name")}, ' ')[1] AS p1,
    CASE WHEN length(string_split({audit_core("business_name")}, ' ')[2]) > 0 THEN string_split({audit_core("business_name")}, ' ')[1] || ' ' || string_split({audit_core("business_name")}, ' ')[2] ELSE string_split({audit_core("business_name")}, ' ')[1] END AS p2,
    string_split({audit_core("business_name")}, ' ')[2] AS tok2, substring(replace({audit_core("business_name")}, ' ', ''), 1, 6) AS cmp6, substring(replace({audit_core("business_name")}, ' ', ''), 1, 7) AS cmp7,
    regexp_extract(coalesce(business_address, ''), '\b[0-9]{{5,6}}\b') AS postal, regexp_extract(coalesce(business_address, ''), '\b[0-9]{{1,4}}\b') AS door, string_split({audit_addr("business_address")}, ' ')[1] AS a1
  FROM rec)"""

SIDES = "s AS (SELECT * FROM prep WHERE entity_id LIKE 'S1-%'), t AS (SELECT * FROM prep WHERE entity_id NOT LIKE 'S1-%')"
LINKS = "links AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id FROM rec a JOIN rec b ON a.country = b.country AND a.same = b.same WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%')"
TRUTH = "truth AS (SELECT s1_id AS source1_entity_id, string_agg(target_id, ',' ORDER BY target_id) AS matched_entity_ids FROM links GROUP BY s1_id)"
WITH_TRUTH = """gt AS (
  SELECT s.*, matched_entity_ids, CASE WHEN coalesce(trim(matched_entity_ids), '') = '' THEN 0 ELSE length(matched_entity_ids) - length(replace(matched_entity_ids, ',', '')) + 1 END AS match_count,
    CASE WHEN coalesce(trim(matched_entity_ids), '') = '' THEN 1 ELSE 0 END AS is_singleton
  FROM s LEFT JOIN truth ON s.entity_id = source1_entity_id)"""
SPLIT = """split AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY country, is_singleton ORDER BY md5(entity_id), entity_id) <= count(*) OVER (PARTITION BY country, is_singleton) * (1.0 - 0.2) THEN 'train' ELSE 'val' END AS split
  FROM gt)"""


def jaccard(a: str, b: str) -> str:
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    return f"(len(list_intersect({x}, {y}))::double / nullif(len(list_distinct(list_concat({x}, {y}))), 0))"


SCORE = f"round(0.6::double * {jaccard('s.norm_name', 't.norm_name')} + 0.4::double * {jaccard('s.norm_addr', 't.norm_addr')}, 12)"
BOTH = ", ".join(f"{side}.{c} AS {name}_{c}" for side, name in (("s", "s1"), ("t", "t")) for c in ("country", "raw_name", "raw_addr", "norm_name", "norm_addr", "postal", "door"))


def passes(names: tuple[str, ...]) -> str:
    """A row for each pass and pair: a join for each pass."""
    joins = []
    for n in names:
        p = PASSES[n]
        on = " AND ".join(f"{_of('s', a)} = {_of('t', b)}" for a, b in zip(p.left, p.right, strict=True))
        least = " AND ".join(f"length({_of('s', a)}) >= {k}" for a, k in zip(p.left, p.least, strict=True))
        joins.append(f"SELECT s.entity_id AS s1_id, t.entity_id AS target_id, '{n}' AS pass FROM s JOIN t ON s.country = t.country AND {on} WHERE {least}")
    return "found AS (" + " UNION ALL ".join(joins) + ")"


def _of(side: str, key: str) -> str:
    return key.replace("(", f"({side}.") if "(" in key else f"{side}.{key}"


PAIRS = "pairs AS (SELECT s1_id, target_id, count(*) AS pass_count FROM found GROUP BY ALL)"


def topk(k: int = 25, extra: str = "") -> str:
    return f"""scored AS (SELECT c.*, {extra} {BOTH}, {SCORE} AS jaccard_score FROM pairs c JOIN s ON s.entity_id = c.s1_id JOIN t ON t.entity_id = c.target_id),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY jaccard_score DESC, pass_count DESC, target_id) AS candidate_rank FROM scored) WHERE candidate_rank <= {k})"""


LABELLED = "labelled AS (SELECT k.*, CASE WHEN l.target_id IS NOT NULL THEN 1 ELSE 0 END AS label FROM topk k LEFT JOIN links l ON k.s1_id = l.s1_id AND k.target_id = l.target_id)"


def _listed(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence: a line of its table for each character of a, from where that stands in b."""
    there = f"list_transform(string_split({a}, ''), lambda c: list_transform(range(1, length({b}) + 1), lambda j: CASE WHEN instr(reverse(substr({b}, 1, j)), c) = 0 THEN 0 ELSE j + 1 - instr(reverse(substr({b}, 1, j)), c) END))"
    start = f"list_transform(range(1, length({b}) + 1), lambda j: 0::bigint)"
    step = "list_transform(range(1, len(line) + 1), lambda j: greatest(line[j], CASE p[j] WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE line[p[j] - 1] + 1 END))"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_extract(list_reduce(list_prepend({start}, {there}), lambda line, p: {step}), -1) END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1::double ELSE 2 * {common(a, b)} / (length({a}) + length({b}))::double END)"


def _parts(c: str) -> str:
    """Of names or addresses: sorted words of both sides, common words, and either side's other words, sorted."""
    x, y = _listed(f"s1_norm_{c}"), _listed(f"t_norm_{c}")
    text = lambda words: f"array_to_string(list_sort({words}), ' ')"
    return ", ".join([
        f"{text(x)} AS {c}_a", f"{text(y)} AS {c}_b", f"len({x}) = 0 OR len({y}) = 0 AS {c}_none", f"{text(f'list_distinct(list_intersect({x}, {y}))')} AS {c}_both",
        f"{text(f'list_distinct(list_filter({x}, lambda v: NOT list_contains({y}, v)))')} AS {c}_one", f"{text(f'list_distinct(list_filter({y}, lambda v: NOT list_contains({x}, v)))')} AS {c}_other",
    ])


def _token_set(c: str) -> str:
    both, one, other = (f"length({c}_{part})" for part in ("both", "one", "other"))
    gap = f"({both} > 0)::int"
    left, right = f"({both} + {gap} + {one})", f"({both} + {gap} + {other})"
    best = f"1 - ({one} + {other} - 2 * {common(f'{c}_one', f'{c}_other')}) / ({left} + {right})::double"
    raised = f"greatest({best}, 1 - ({gap} + {one}) / ({both} + {left})::double, 1 - ({gap} + {other}) / ({both} + {right})::double)"
    return f"CASE WHEN {c}_none THEN 0 WHEN {both} > 0 AND ({one} = 0 OR {other} = 0) THEN 1 WHEN {both} > 0 THEN {raised} ELSE {best} END"


def measured(of: str, sets: bool = False) -> str:
    """Rows of a top-K list with token sort ratios and, if asked for, token set ratios and ratios."""
    more = [f"({_token_set(c)})::double AS {c}_set, {ratio(f's1_norm_{c}', f't_norm_{c}')} AS {c}_ratio" for c in ("name", "addr")] if sets else []
    every = ", ".join(["*", *(f"{ratio(f'{c}_a', f'{c}_b')} AS {c}_sort" for c in ("name", "addr")), *more])
    return f"measured AS (SELECT {every} FROM (SELECT *, {_parts('name')}, {_parts('addr')} FROM {of}))"


def strategies(depths: dict[str, tuple[str, int]], named: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """topk_A, topk_B, ...: the list of each compared strategy. E adds `ngrams` to its passes, F those and three address passes."""
    out = []
    for n, (plain, k) in depths.items():
        out.append(passes(named[plain]).replace("found AS", f"found_{n} AS", 1))
        every = f"SELECT s1_id, target_id, count(*) AS pass_count FROM found_{n} GROUP BY ALL"
        if n in ("E", "F"):
            every += " UNION ALL SELECT s1_id, target_id, 1 FROM ngrams"
        if n == "F":
            out.append(passes(("F1", "F2", "F3")).replace("found AS", "more_F AS", 1))
            every += " UNION ALL SELECT s1_id, target_id, 1 FROM more_F"
        out.append(f"pairs_{n} AS (SELECT s1_id, target_id, max(pass_count) AS pass_count FROM ({every}) GROUP BY ALL)")
        out.append(topk(k).replace("scored AS", f"scored_{n} AS").replace("topk AS", f"topk_{n} AS").replace("FROM pairs c", f"FROM pairs_{n} c").replace("FROM scored)", f"FROM scored_{n})"))
    return tuple(out)


def query(select: str, *ctes: str, docs: bool = False, audit: bool = False) -> str:
    """A query over the part or document records and further common table expressions."""
    return "WITH " + ",\n".join([DOCS_SQL if docs else PART_SQL, AUDIT_PREP if audit else PREP, SIDES, LINKS, TRUTH, *ctes]) + "\n" + select
