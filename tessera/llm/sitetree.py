"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element's place in it is the chain of tags, classes and ids that leads
to it. A place keeps how many pages have it, in which presentations (the tags of its children) and, if it has text of
its own, with which contents. With m the pages that have a place and df those with the same content, a content's
information is 1 - log_m(df). Two things are removed where at least MIN_PAGES pages have a place:

* Branches, with all below them. Where the tree forks, a branch's importance is SHAPE times the greatest entropy of a
  presentation in it (its log to base m) and 1 - SHAPE times the mean information of its contents. A branch of less
  than BRANCH times the importance of the host's greatest at that fork, whose contents also inform by at least MARGIN
  less, is cut: the texts of menus, adverts and notices come again on other pages, in the same shape. The tree is
  followed into the other branches down to the articles. Branches with html, body, main or article in them stay.
* Contents. The importance of a place is 1 - GAMMA times the entropy of its presentations and GAMMA times the
  information, at most 1, that its contents that aren't shared (of at least LEAST) give a page on average; shared ones
  beside them take none away. Where it is below LEAST, the place's shared contents are removed.

Contents that few pages have stay in all other places, as does what stands directly in html, body, main or article.
If all of a page's articles (or its main part, or its body) would go, as on a host made of copies, they stay.

Hosts with few pages tell little by statistics, so elements whose tag, role or name says that they are menus, headers,
footers, sidebars, notices, adverts, forms, scripts or reader comments go as well (`named`); names of headings and ids
of paragraphs don't count, and forms that hold most of a page's text are no noise. What is left of the page's articles
(or its main part, or its body) is its text: white space within a block becomes one blank, and blocks are joined by
one blank.

Edge cases: a null or empty page has the empty text; a null URL is a host of its own; markup that ends within a tag or
comment ends there; repeated rows count as pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, store, tidy

GAMMA = 0.9
LEAST = 0.2
SHAPE = 0.5
BRANCH = 0.8
MARGIN = 0.05
MIN_PAGES = 8
MIN_PAGE_SHARE = 0.01
"""Branches fewer of a host's pages have aren't judged, so a host's tree has at most so many places a page's size over this."""
FLUSH = 400_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",)}

NOISE_TAGS = frozenset("aside button canvas datalist dialog footer form head input menu nav object search select svg".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_NAME = re.compile(
    r"(?:site|page|main|top|bottom|global|left|right|primary|secondary|social|user|reader|article|post|blog|related|google|skip|cookie|privacy|legal)?[-_]*"
    r"(?:ads?|adbox|adslot|adunit|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|commentlist|respond|disqus|discussion|consent|cookies?|gdpr|footer|colophon|forms?|login|signin|signup|menu|masthead|"
    r"modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pagination|pager|popup|promo|promotion|recommended|recommendations|related|replies|search|searchbox|share|sharing|sidebar|sidenav|skip|social|sponsor|sponsored|subscribe|toolbar|topbar|widgets?)"
    r"(?:[-_]*(?:area|author|bar|block|body|box|cards?|container|content|form|inner|items?|links?|list|menu|section|slot|teasers?|text|thread|top|bottom|left|right|wrap|wrapper|\d+))*"
)
HEADER_NAME = re.compile(r"(?:site|page|main|top|global)?[-_]*header(?:[-_]*(?:area|bar|inner|top|wrap|wrapper|\d+))*")
KEPT_TAGS = frozenset(("html", "body", "main", "article"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

PAGES, FORMS, CONTENTS, KEPT = range(4)
"""Kinds of counts."""

BREAK = (None, False, False, False, False, False)

_tag = re.compile(r"<([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_attribute = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>`]++)))?")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host(url: str | None) -> str:
    """The host of a URL in lower case; empty if it has none."""
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def _hash(data: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page's markup: text, start and end tags, in time that grows with the page only."""
    at, start = 0, 0
    while (lt := page.find("<", at)) >= 0:
        c = page[lt + 1 : lt + 2]
        if c.isascii() and c.isalpha():
            if lt > start:
                yield "text", "", page[start:lt]
            m = _tag.match(page, lt)
            if not m:
                return
            name = m.group(1).lower()
            yield "start", name, m.group(2)
            at = start = m.end()
            if name in RAW and not m.group(2).endswith("/"):
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                if not end:
                    return
                at = start = end.start()
        elif c in ("/", "!", "?"):
            if lt > start:
                yield "text", "", page[start:lt]
            if page.startswith("<!--", lt):
                close, skip = page.find("-->", lt + 2), 3
            else:
                close, skip = page.find(">", lt), 1
            if close < 0:
                return
            if c == "/" and (name := page[lt + 2 : close].split(maxsplit=1)[0:1]):
                yield "end", name[0].rstrip("/").lower(), ""
            at = start = close + skip
        else:
            at = lt + 1
    if start < len(page):
        yield "text", "", page[start:]


class Node:
    """An open element."""

    __slots__ = ("tag", "place", "noise", "header", "kinds", "article", "main", "own", "low")

    def __init__(self, tag: str, place: int, noise: int, header: bool, article: bool, main: bool, low: bool = False):
        self.tag, self.place, self.noise, self.header, self.article, self.main, self.low = tag, place, noise, header, article, main, low
        self.kinds: list[str] = []
        self.own: list[int] = []


def named_noise(tag: str, attributes: str) -> tuple[int, bool, str, str]:
    """What an element's tag, role and names say: whether it is noise (2, or 1 for a form; walk() gives scripts and heads 3) and a header; its role; its names for its place."""
    noise, header, role = (1 if tag == "form" else 2 * (tag in NOISE_TAGS)), tag == "header", ""
    names = []
    if "=" in attributes:
        for key, *values in _attribute.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "role":
                role = value.strip().lower()
                noise = max(noise, 2 * (role in NOISE_ROLES))
            elif key in ("class", "id"):
                silent = tag in HEADINGS or tag == "p" and key == "id"
                for x in value.split():
                    low = _camel.sub("-", x).lower()
                    names.append(re.sub(r"\d+", "0", low))
                    if not silent and NOISE_NAME.fullmatch(low):
                        noise = 2
                    header |= not silent and bool(HEADER_NAME.fullmatch(low))
    if tag in ("html", "body", "main"):
        noise = header = False
    return int(noise), bool(header), role, ".".join(sorted(names))


def walk(page: str, low: frozenset[int] = frozenset(), seen: Counter | None = None, named: bool = True) -> list[tuple]:
    """The page's pieces of text: (text or None for a break, noise, header, in an article, in the main part, low).

    low: places of branches, and place ^ content of texts, that tell too little. With `seen`, the page's places (with
    the places above them), presentations and contents are counted in it.
    """
    stack = [Node("", 0, 0, False, False, False)]
    opened: defaultdict[str, list[int]] = defaultdict(list)
    out: list[tuple] = []
    found: set[tuple] = set()
    judged = bool(low) or seen is not None

    def close() -> None:
        n = stack.pop()
        opened[n.tag].pop()
        if seen is not None:
            found.add((n.place, PAGES, stack[-1].place))
            found.add((n.place, FORMS, _hash(",".join(n.kinds))))
            if n.tag in KEPT_TAGS:
                found.add((n.place, KEPT, int(n.tag == "article")))
        if n.own:
            content = _hash(" ".join("".join([out[i][0] for i in n.own]).split()))
            if seen is not None:
                found.add((n.place, CONTENTS, content))
            if n.place ^ content in low:
                for i in n.own:
                    out[i] = (*out[i][:5], True)
        if n.tag not in INLINE:
            out.append(BREAK)

    for kind, name, rest in tokens(page):
        top = stack[-1]
        if kind == "text":
            if judged and top.noise < 3 and top.tag not in KEPT_TAGS and len(stack) > 1 and not rest.isspace():
                top.own.append(len(out))
            out.append((rest, top.noise, top.header, top.article, top.main, top.low))
        elif kind == "start":
            if name in CLOSES_P and opened["p"]:
                while stack[-1].tag in INLINE or stack[-1].tag == "p":
                    close()
                    if not opened["p"]:
                        break
            elif name in CLOSES:
                reach = max((opened[t][-1] for t in (*SCOPE.get(name, ()), *CLOSES[name]) if opened[t]), default=0)
                if reach and stack[reach].tag in CLOSES[name]:
                    while len(stack) > reach or (stack[-1].tag in CLOSES[name]):
                        close()
            top = stack[-1]
            if name not in INLINE:
                out.append(BREAK)
            top.kinds.append(name)
            if name in VOID or name in ("script", "style"):
                continue
            noise, header, role, names = named_noise(name, rest)
            place = _hash(f"{top.place}>{name}.{names}")
            if not named:
                noise = header = 0
            noise = 3 if name in RAW or name == "head" else max(noise, top.noise)
            node = Node(name, place, noise, top.header or bool(header), top.article or name == "article" and noise < 2, top.main or name == "main" or role == "main", top.low or place in low)
            if header and (top.article or top.main):
                node.header = top.header
            if not rest.endswith("/") or name not in ("svg", "path"):
                opened[name].append(len(stack))
                stack.append(node)
        elif opened.get(name):
            while stack[-1].tag != name:
                close()
            close()
        elif name in ("p", "br"):
            out.append(BREAK)
    while len(stack) > 1:
        close()
    if seen is not None:
        seen.update(found)
    return out


def main_text(page: str | None, low: frozenset[int] = frozenset(), named: bool = True) -> str:
    """The text of a page's articles, or else its main part, or else its body, without noise.

    low: as in walk(). The first of these parts that has text, but none that isn't low, stays beside what is taken.
    """
    pieces = [x for x in walk(page or "", low, None, named) if x[0] is None or not (x[1] > 1 or x[2])]
    in_forms, outside = (sum(len(x[0]) for x in pieces if x[0] is not None and x[1] == i and not x[0].isspace()) for i in (1, 0))
    if in_forms <= outside:
        pieces = [x for x in pieces if x[0] is None or not x[1]]
    spared = None

    def joined(part: int | None, every: bool) -> str:
        taken = lambda x: (part is None or x[part]) and (every or not x[5]) or spared is not None and x[spared]
        return " ".join(entities.unescape("".join([" " if x[0] is None else x[0] for x in pieces if x[0] is None or taken(x)])).split())

    for part in (3, 4, None):
        if any(x[0] is not None and (part is None or x[part]) and not x[5] and entities.unescape(x[0]).strip() for x in pieces):
            return joined(part, False)
        if spared is None and part is not None and joined(part, True):
            spared = part
    return joined(None, spared is None)


def _merge(batches: Iterator[pa.RecordBatch], named: bool) -> Iterator[pa.RecordBatch]:
    """(host, place, kind, item, pages): PAGES (item is the place above), FORMS, CONTENTS, and KEPT for html, body, main (item 0) and article (item 1)."""
    seen: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        flat = [(h, *k, n) for h, c in seen.items() for k, n in c.items()]
        columns = list(zip(*flat, strict=True)) if flat else [()] * 5
        seen.clear()
        return pa.record_batch([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=["host", "place", "kind", "item", "pages"])

    held = 0
    for b in tidy(batches):
        for url, page in zip(b.column(0), b.column(1), strict=True):
            walk(page.as_py() or "", seen=(c := seen.setdefault(host(url.as_py()), Counter())), named=named)
        held = sum(map(len, seen.values()))
        if held > FLUSH:
            yield rows()
            held = 0
    yield rows()


def cut_branches(places: list[tuple[int, int, int, float, float, float]], share: float = SHAPE, branch: float = BRANCH, margin: float = MARGIN) -> list[int]:
    """The places of the branches that are cut from a host's tree.

    places: (place, the one above, whether it's kept (2 for articles, which aren't looked into), entropy of
    presentations, contents, their information), the last two sums over pages.
    """
    below = defaultdict(list)
    known = {p[0]: p for p in places}
    for p in places:
        below[p[1] if p[1] in known else None].append(p[0])
    order, todo = [], list(below[None])
    while todo:
        order.append(todo.pop())
        todo += below[order[-1]]
    shape, contents, told, kept = {}, {}, {}, {}
    for p in reversed(order):
        _, _, k, form, n, bits = known[p]
        shape[p] = max([form, *(shape[c] for c in below[p])])
        contents[p] = n + sum(contents[c] for c in below[p])
        told[p] = bits + sum(told[c] for c in below[p])
        kept[p] = k > 0 or any(kept[c] for c in below[p])
    cut, todo = [], [None]
    while todo:
        fork = [c for c in below[todo.pop()] if contents[c]]
        told_by = {c: told[c] / contents[c] for c in fork}
        value = {c: share * shape[c] + (1 - share) * told_by[c] for c in fork}
        best = max(fork, key=lambda c: (value[c], c), default=None)
        for c in fork:
            if not kept[c] and value[c] < branch * value[best] and told_by[c] <= told_by[best] - margin:
                cut.append(c)
            elif known[c][2] < 2:
                todo.append(c)
    return sorted(cut)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tidy(batches):
        found = [cut_branches([tuple(p[k] for k in ("place", "above", "kept", "form", "contents", "told")) for p in tree]) for tree in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["host", "cut"])


def low_places(pages: DataFrame, url: str = "url", page: str = "html", least: float = LEAST, min_pages: int = MIN_PAGES, named: bool = True) -> DataFrame:
    """(host, low): the places of cut branches, and place ^ content of the shared contents in places of little importance.

    A page of c contents has at most c that are shared, each by over m ** (1 - least) of m pages, so a host has at most
    c * m ** least of them. A host's tree meets in one row: of pages with e elements it has at most e / MIN_PAGE_SHARE
    places.
    """
    merged = pages.select(url, page).mapInArrow(lambda it: _merge(it, named), "host string, place long, kind long, item long, pages long")
    counts = store(merged.groupBy("host", "place", "kind", "item").agg(F.sum("pages").alias("pages")), "counts")
    sizes = counts.filter(F.col("kind") == PAGES).filter(F.col("pages") >= max(2, min_pages)).select("host", "place", F.col("item").alias("above"), F.col("pages").alias("m"))
    df, kind = F.col("pages").cast("double"), F.col("kind")
    told = 1 - F.log(df) / F.log("m")
    rows = counts.filter(kind > PAGES).join(sizes, ["host", "place"])
    of = lambda k, x: F.coalesce(F.sum(F.when(kind == k, x)), F.lit(0.0))
    sums = rows.groupBy("host", "place", "above", "m").agg(
        of(FORMS, df * F.log(df)).alias("forms_log"), of(FORMS, df).alias("forms"), of(CONTENTS, df).alias("contents"), of(CONTENTS, df * told).alias("told"),
        F.coalesce(F.sum(F.when((kind == CONTENTS) & (told >= least), df * told)), F.lit(0.0)).alias("own"), F.count(F.when((kind == CONTENTS) & (told < least), 1)).alias("shared"),
        F.coalesce(F.max(F.when(kind == KEPT, F.col("item") + 1)), F.lit(0)).alias("kept"),
    )
    # A sum of n values' entropies to base m: (log n - sum(x log x) / n) / log m.
    form = F.coalesce((F.log("forms") - F.try_divide("forms_log", "forms")) / F.log("m"), F.lit(0.0))
    sums = store(sums.withColumn("form", form), "places")
    weak = sums.filter("shared > 0").filter((1 - GAMMA) * F.col("form") + GAMMA * F.least(F.col("own") / F.col("m"), F.lit(1.0)) < least).select("host", "place", "m")
    texts = counts.filter(kind == CONTENTS).join(weak, ["host", "place"]).filter(told < least).select("host", F.col("place").bitwiseXOR(F.col("item")).alias("text"))
    texts = texts.groupBy("host").agg(F.collect_set("text").alias("texts"))
    # Sums are rounded: their order may differ between runs.
    tree = F.struct("place", "above", "kept", F.round("form", 9).alias("form"), "contents", F.round("told", 6).alias("told"))
    widest = sums.groupBy("host").agg(F.max("m").alias("most"))
    trees = sums.join(widest, "host").filter(F.col("m") >= MIN_PAGE_SHARE * F.col("most")).groupBy("host").agg(F.array_sort(F.collect_list(tree)).alias("tree"))
    cut = trees.mapInArrow(_cut, "host string, cut array<long>").filter(F.size("cut") > 0)
    none = F.array().cast("array<long>")
    low = store(texts.join(cut, "host", "full").select("host", F.array_sort(F.concat(F.coalesce("texts", none), F.coalesce("cut", none))).alias("low")), "low")
    discard(counts, sums)
    return low


def _extract(batches: Iterator[pa.RecordBatch], page: int, named: bool) -> Iterator[pa.RecordBatch]:
    before, low = None, frozenset()
    for b in tidy(batches):
        n = b.num_columns
        texts = []
        for p, texts_low in zip(b.column(page), b.column(n - 1), strict=True):
            now = texts_low.as_py()
            if now != before:
                before, low = now, frozenset(now or ())
            texts.append(main_text(p.as_py(), low, named))
        kept = [i for i in range(n - 1) if i != page]
        yield pa.record_batch([*(b.column(i) for i in kept), pa.array(texts, pa.string())], names=[*(b.schema.names[i] for i in kept), "_text"])


def extract(pages: DataFrame, keep: list[str], url: str = "url", page: str = "html", named: bool = True) -> DataFrame:
    """The columns `keep` of pages and `_text`. named: whether names, tags and roles count beside the tree."""
    weak = low_places(pages, url, page, named=named)
    rest = F.split_part(F.coalesce(F.col(url), F.lit("")), F.lit("://"), F.lit(2))
    name = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    rows = pages.select(F.struct(*keep).alias("_keep"), F.col(page).alias("_page"), F.lower(F.split_part(name, F.lit(":"), F.lit(1))).alias("_host"))
    joined = rows.join(weak, rows["_host"] == weak["host"], "left").select("_keep", "_page", "low")
    kinds = f"_keep {joined.schema['_keep'].dataType.simpleString()}, _text string"
    return joined.mapInArrow(lambda it: _extract(it, 1, named), kinds).select("_keep.*", "_text")


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
    return found.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
