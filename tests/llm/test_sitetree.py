from collections import Counter

from tessera.llm import sitetree as S

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1></header><nav><a href=x>menu</a></nav><!-- no --><script>var t="<p>no</p>";</script>
<div class="cookie-notice">cookies</div><div id="leftSidebar"><p>side</p></div>
<article class="post"><h1>A &amp; B&nbsp;C</h1><p>one  <b>tw</b>o<p>three<br>four <ul><li>five<li>six</ul><div class="ad">buy</div>
<form><input name=q>find</form><aside>aside</aside> a < b &lt; c </article>
<section class="comments"><p>first!</p></section><footer>foot</footer></body></html>"""


def test_main_text():
    assert S.main_text(PAGE) == "A & B C one two three four five six a < b < c"
    assert S.main_text(None) == S.main_text("") == S.main_text("<div") == S.main_text("<!-- x") == ""
    assert S.main_text("<p>plain") == "plain"
    assert S.main_text("<body><main><p>x</p><nav>n</nav></main><p>y</body>") == "x"
    assert S.main_text("<div><div><p>deep</div></span></p></div> end") == "deep end"


def test_hosts():
    assert [S.host(u) for u in ("http://A.b:80/c?d", "https://u:p@x.y#z", "nothing", None, "http://q?x")] == ["a.b", "x.y", "", "", "q"]


def test_long_markup_takes_linear_time():
    assert S.main_text("<p>" * 20_000 + "x") == "x"
    assert S.main_text("<div>" * 5_000 + "x" + "</span>" * 50_000) == "x"
    assert S.main_text("<a b='" + "x" * 500_000) == ""


def test_template_branches_go(spark):
    """A block that all pages of a host share goes though no name tells it is noise; on a host of few pages it stays."""
    page = lambda i: f"<body><div class=intro><p>Same line of all pages</p></div><div class=own><p>Own words {i} {i * i}</p></div></body>"
    rows = [(i, f"http://many.example/{i}", page(i)) for i in range(30)] + [(100 + i, f"http://few.example/{i}", page(100 + i)) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["_text"] for r in S.extract(pages.repartition(3), ["page_id"]).collect()}
    assert all(got[i] == f"Own words {i} {i * i}" for i in range(30))
    assert got[101] == "Same line of all pages Own words 101 10201"


def test_counts_of_a_page():
    seen = Counter()
    S.walk("<div><p>a</p><p>b</p></div>", seen=seen)
    kinds = Counter(k[1] for k in seen)
    assert kinds[0] == 2 and kinds[1] == 2


def test_sample_of_pages(spark, data):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in S.op8_site_style_tree(spark, data).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


def texts(spark, rows):
    """By number, the texts of pages of one host."""
    pages = spark.createDataFrame([(i, f"http://one.example/{i}", h) for i, h in rows], "page_id long, url string, html string")
    return {r["page_id"]: r["_text"] for r in S.extract(pages.repartition(3), ["page_id"]).collect()}


def test_short_articles_among_fixed_texts_stay(spark):
    """However many texts all pages share, those of one page stay: in an article, in blocks and in blocks that look like the fixed ones."""
    own = lambda i: [f"Block {j} of text {i}" for j in range(5)]
    for fixed in (20, 40, 200):
        links = "".join(f"<li><a href=x>Link {j}</a></li>" for j in range(fixed))
        same = "".join(f"<p>Fixed {j}</p>" for j in range(fixed))
        blocks = lambda i: "".join(f"<p>{x}</p>" for x in own(i))
        for page in (
            lambda i: f"<html><body><ul>{links}</ul><article>{blocks(i)}</article></body></html>",
            lambda i: f"<body><div class=x><ul>{links}</ul></div><div class=y>{blocks(i)}</div></body>",
        ):
            assert texts(spark, [(i, page(i)) for i in range(12)]) == {i: " ".join(own(i)) for i in range(12)}
    flat = texts(spark, [(i, f"<body><div>{same}{blocks(i)}</div></body>") for i in range(12)])
    assert all(flat[i].endswith(" ".join(own(i))) for i in range(12))


def test_hosts_of_copies_keep_their_texts(spark):
    page = lambda i: f"<body><div class=links><a>Start</a></div><article><h1>Head {i}</h1><p>First {i}</p><p>Second {i}</p></article></body>"
    want = lambda i: f"Head {i} First {i} Second {i}"
    assert set(texts(spark, [(i, page(0)) for i in range(40)]).values()) == {want(0)}
    got = texts(spark, [(i, page(max(i, 39))) for i in range(44)])
    assert all(got[i] == want(i) for i in range(40, 44))
    assert all(want(39).endswith(got[i]) and got[i] for i in range(40))
    plain = lambda i: f"<body><div><p>Same</p></div><p>Page {i}</p><article><p>All alike</p></article></body>"
    assert texts(spark, [(i, plain(i)) for i in range(20)]) == {i: f"Page {i} All alike" for i in range(20)}


def test_items_close_at_any_depth():
    """An item's end is implied however many elements are open in it; its names don't reach the next item."""
    for depth in (10, 63, 64, 65, 500):
        open_tags = "<div>" * depth
        assert S.main_text(f"<ul><li class=ad>{open_tags}no<li>yes</ul>") == "yes"
        assert S.main_text(f"<table><tr class=menu><td>{open_tags}no<tr><td>yes</table>") == "yes"
        assert S.main_text(f"<ul><li>{open_tags}a<ul><li class=ad>no<li>b</ul></ul>") == "a b"
    assert S.main_text("<ul>" + "<li><div>x" * 20_000).count("x") == 20_000


def test_deep_articles_stay(spark):
    """Texts of one page count wherever they are, and fixed ones go from any depth."""
    for depth in (10, 30, 300):
        page = lambda i: f"<body><div class=w><p>Fixed</p>{'<div><font>' * depth}<p>Own {i}</p><i>Same</i>"
        assert texts(spark, [(i, page(i)) for i in range(12)]) == {i: f"Own {i}" for i in range(12)}


def test_names_are_read_as_attributes():
    """Only an element's own class, id and role count, not what other attributes' names and values hold."""
    for attributes in ('data-id="comments"', 'aria-invalid="menu"', 'title="class=nav"', "title='role=navigation'", 'x-class=ad', 'id="comments"'):
        assert S.main_text(f"<body><p {attributes}>kept</p></body>") == "kept", attributes
    for attributes in ('class="ad"', "CLASS = 'x sidebar'", "id=comments title=x", 'a="b" role="navigation"', "hidden role=menu"):
        assert S.main_text(f"<body><div {attributes}>gone</div><p>kept</body>") == "kept", attributes
    assert S.main_text('<body><h2 id="comments">Comments on the law</h2><h3 class=menu>Menu</h3></body>') == "Comments on the law Menu"


def test_articles_that_are_comments_or_teasers():
    assert S.main_text('<article><p>Story</p><article class="comment"><p>First!</p></article></article>') == "Story"
    assert S.main_text('<div>Real story</div><article class="related-card">teaser</article>') == "Real story"
    assert S.main_text('<main role="x">a</main><div role="main">b</div>') == "a b"


def test_forms():
    """A form that holds most of a page is no noise; what is noise in it still is."""
    assert S.main_text("<body><form><div><p>All the text of a page</p><nav>menu</nav></div></form><div>x</div></body>") == "All the text of a page x"
    assert S.main_text("<body><div>A text that is longer</div><form>your name</form></body>") == "A text that is longer"


def plain_tree(pages):
    """Cut branches and shared contents by the definition, over chains of tags and classes, with nothing hashed."""
    import math
    from html.parser import HTMLParser

    above, forms, contents, has = {}, Counter(), Counter(), Counter()

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            self.stack[-1][1].append(tag)
            chain = (*self.stack[-1][0], (tag, dict(attrs).get("class")))
            self.stack.append((chain, [], []))

        def handle_data(self, data):
            self.stack[-1][2].append(data)

        def handle_endtag(self, tag):
            chain, kinds, texts = self.stack.pop()
            self.seen.add((chain, "pages", None))
            self.seen.add((chain, "form", tuple(kinds)))
            if "".join(texts).strip() and chain[-1][0] not in S.KEPT_TAGS:
                self.seen.add((chain, "text", " ".join("".join(texts).split())))

    for p in pages:
        reader = Reader()
        reader.stack, reader.seen = [((), [], [])], set()
        reader.feed(p)
        for chain, kind, item in reader.seen:
            {"pages": has, "form": forms, "text": contents}[kind][(chain, item)] += 1
    m = {c: n for (c, _), n in has.items() if n >= S.MIN_PAGES}

    def entropy(c):
        n = [v for (x, _), v in forms.items() if x == c]
        return -sum(v / sum(n) * math.log(v / sum(n), m[c]) for v in n)

    told = lambda c, df: 1 - math.log(df, m[c])
    inside = lambda c: [x for x in m if x[: len(c)] == c]
    texts = lambda c: [(x, df) for (x, _), df in contents.items() if x in m and x[: len(c)] == c]
    mean = lambda c: sum(df * told(x, df) for x, df in texts(c)) / sum(df for _, df in texts(c))
    value = lambda c: S.SHAPE * max(map(entropy, inside(c))) + (1 - S.SHAPE) * mean(c)
    kept = lambda c: any(x[-1][0] in S.KEPT_TAGS for x in inside(c))
    cut, todo = set(), [()]
    while todo:
        at = todo.pop()
        fork = [c for c in m if len(c) == len(at) + 1 and c[: len(at)] == at and texts(c)]
        for c in fork:
            best = max(fork, key=value)
            if not kept(c) and value(c) < S.BRANCH * value(best) and mean(c) <= mean(best) - S.MARGIN:
                cut.add(c)
            elif c[-1][0] != "article":
                todo.append(c)
    shared = {(c, t) for (c, t), df in contents.items() if c in m and told(c, df) < S.LEAST}
    own = lambda c: min(1, sum(df * told(c, df) for (x, _), df in contents.items() if x == c and told(c, df) >= S.LEAST) / m[c])
    shared = {(c, t) for c, t in shared if (1 - S.GAMMA) * entropy(c) + S.GAMMA * own(c) < S.LEAST}
    return cut, shared


def test_tree_against_plain_tree(spark):
    """The places and contents found by counting hashes are those of a tree built the plain way."""
    import random

    def place(chain):
        at = 0
        for tag, names in chain:
            at = S._hash(f"{at}>{tag}.{names or ''}")
        return at

    for seed in range(6):
        r = random.Random(seed)

        def page(i):
            links = "".join(f"<li>item {r.randint(0, 5)}</li>" for _ in range(r.randint(2, 4)))  # noqa: B023
            body = "".join(f"<{t}>own {i} {r.random()}</{t}>" for t in r.choices(("p", "h3", "pre"), k=r.randint(1, 6)))  # noqa: B023
            return f"<body><div class='a'><ul>{links}</ul></div><div class='b'>offer {r.randint(0, 3)}</div><div class='c'><section><p>Fixed</p>{body}</section><div class='d'>see {r.randint(0, 4)}</div></div></body>"  # noqa: B023

        pages = [page(i) for i in range(24)]
        cut, shared = plain_tree(pages)
        want = {place(c) for c in cut} | {place(c) ^ S._hash(t) for c, t in shared}
        df = spark.createDataFrame([(f"http://one.example/{i}", p) for i, p in enumerate(pages)], "url string, html string")
        got = {x for row in S.low_places(df.repartition(3)).collect() for x in row["low"]}
        assert got == want and len(cut) >= 2, seed


def test_branches_go_without_names(spark):
    """With names switched off, the tree alone takes menus, offers and notices from a host's pages, and no title or article."""
    r = __import__("random").Random(1)
    own = lambda i: " ".join(f"Sentence {j} of {i}." for j in range(i % 5 + 1))
    blocks = lambda i: "".join(f"<p>{own(i)} {j}</p>" + "<hr>" * (j % 2) for j in range(1 + i % 4))
    page = lambda i: f"<body><h1>Title {i}</h1><div><ul>{''.join(f'<li>Link {r.randint(0, 9)}</li>' for _ in range(5))}</ul></div><div class=x>Offer {i % 6}</div><section>{blocks(i)}</section><div class=y>Made by {i % 3}</div></body>"
    pages = spark.createDataFrame([(i, f"http://one.example/{i}", page(i)) for i in range(40)], "page_id long, url string, html string")
    got = {x["page_id"]: x["_text"] for x in S.extract(pages, ["page_id"], named=False).collect()}
    assert all(got[i] == " ".join([f"Title {i}", *(f"{own(i)} {j}" for j in range(1 + i % 4))]) for i in range(40))


def test_tree_alone_on_sample_pages(spark):
    """On the given pages, names switched off, most texts outside articles are in cut branches and none inside."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    low = {r["host"]: frozenset(r["low"]) for r in S.low_places(pages).collect()}
    pieces = [x for r in pages.collect() for x in S.walk(r["html"], low.get(S.host(r["url"]), frozenset()), None, False) if x[0] and not x[0].isspace() and x[1] < 3]
    outside = [x[5] for x in pieces if not x[3]]
    assert len(low) >= 50 and sum(outside) > 0.9 * len(outside) and not any(x[5] for x in pieces if x[3])
