"""Article extraction on small pages, and near-duplicate titles against plain Python."""

import itertools
import re

from tidemark.functions.extract import article, articles
from tidemark.plans.documents import c2_near_titles

SF = "/root/testdata/sf0.001"


def test_container_and_blocks():
    page = "<html><head><title>x</title></head><body><nav><a href='/'>home</a></nav><div class=ad>Buy.</div><article><h1>Name &amp; more</h1><p>First <a href='#'>linked</a> one.<p>Second<br>one.<ul><li>item</ul></article><footer>end</footer></body></html>"
    assert article(page) == ("article", [("heading", "Name & more"), ("paragraph", "First linked one."), ("paragraph", "Second one."), ("item", "item")])


def test_links_lose_and_children_narrow():
    links = "<div>" + "<p><a href='#'>a long list of links to elsewhere</a></p>" * 20 + "</div>"
    prose = "<section><p>" + "Plain prose that says something. " * 20 + "</p></section>"
    assert article(f"<body>{links}{prose}</body>")[0] == "section"
    assert article(f"<body><div>{prose}</div><p>short</p></body>")[0] == "section"
    assert article("<body><p>" + "one " * 50 + "</p><div><p>" + "two " * 50 + "</p></div></body>")[0] == "body"


def test_odd_pages():
    assert article(None) == article("") == article("  ") == (None, [])
    assert article("plain text") == (None, [("paragraph", "plain text")])
    assert article("<nav><p>only chrome, never closed")[1] == [("paragraph", "only chrome, never closed")]
    assert article("</div><div><p>stray end</span></div>") == ("div", [("paragraph", "stray end")])
    assert article("<div>" * 5000 + "deep")[1] == [("paragraph", "deep")]


def test_articles_table(spark):
    df = spark.createDataFrame([(1, "<div><p>a</p></div>", 5), (1, None, 6), (None, "", 7)], "page_id long, html string, blocks int")
    got = [(r.page_id, r.container, [tuple(b) for b in r.blocks]) for r in articles(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "div", [("paragraph", "a")]), (1, None, []), (None, None, [])], key=repr)
    assert articles(df.limit(0)).count() == 0


def test_near_titles(spark):
    """Pairs of equal titles from different sources are found, and every reported pair has the overlap that it claims."""
    plain = lambda t: re.sub(r"[^\w]+|_", " ", (t or "").lower()).strip().split()[:12]
    rows = {r.doc_id: (r.source or "", plain(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r.id, r.other): r for r in c2_near_titles(spark, SF).collect()}
    firsts = {}
    for i in sorted(rows):
        firsts.setdefault((rows[i][0], tuple(rows[i][1])), i)
    want = {(a, b) for a, b in itertools.combinations(sorted(firsts.values()), 2) if rows[a][1] and rows[a][1] == rows[b][1] and rows[a][0] != rows[b][0]}
    assert want <= {p for p, r in got.items() if r.outcome == "auto"}
    for (a, b), r in got.items():
        x, y = ({w for w in rows[i][1] if len(w) > 2} for i in (a, b))
        assert rows[a][0] != rows[b][0] and abs(r.overlap - (len(x & y) / len(x | y) if x | y else 0)) < 1e-9


def test_references_cut_short_stay_and_advertisements_are_no_article():
    assert article("<div><p>R&amp;D &amp</p></div>") == ("div", [("paragraph", "R&D &amp")])
    ad = "<div class='Top ad'><div>" + "Buy this. " * 20 + "</div></div>"
    assert article(f"<body>{ad}<article><p>short</p></article></body>")[0] == "body"
    assert article(f"{ad}<section><p>short</p></section>")[0] == "section"
    assert article(ad)[0] == "div"
