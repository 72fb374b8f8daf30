import html as entities
import re

from pyspark.sql import functions as F

from rivulet.llm import html


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df, **options):
    return {r.page_id: r.main_text for r in html.extract(df, **options).collect()}


def test_documented_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in html.query(spark, "/root/testdata/sf0.01").collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>|<[^<>]*$", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert found[r.page_id].text == "\n".join(b for b in blocks if b)
        assert found[r.page_id].n_chars == len(found[r.page_id].text)


def test_furniture_markup_and_references():
    page = """<html class="no-sidebar"><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">Accept?</div>
    <header>Site</header><ul class="menu"><li>Home<li>News</ul><main><article><h1>A &amp; B</h1><div class='share'>Share</div>
    <p>First&nbsp;<b>bold</b>
    text<p>Second &lt;x&gt; line<br>goes on<script>if (a < b) "</p>"</script><table><tr><td>cell</table>
    <aside>Aside</aside><form><p>Search<input></form><section id="comments"><p>Nice!</section><!-- <p>no --></article></main>
    <div role="contentinfo">(c)</div><footer>Foot</footer>"""
    assert html.Page(page).main_text(set()) == "A & B\nFirst bold text\nSecond <x> line goes on\ncell"


def test_template_text_is_dropped_without_an_article(spark):
    page = "<div><p>Read more on our site every single day</p><div><p>{0} story one {0}</p><p>{0} story two {0}</p></div><p>Made with care by the whole team</p></div>"
    rows = [(i, "http://a.example/x", page.format(f"w{i}")) for i in range(8)] + [(99, "http://b.example/", page.format("z"))]
    for limit in (0, html.MOST_BROADCAST):
        found = texts(pages(spark, rows), most_broadcast=limit)
        assert all(found[i] == f"w{i} story one w{i}\nw{i} story two w{i}" for i in range(8))
        assert "Made with care" in found[99]  # one page alone has no template


def test_classes_are_ordered_and_nested(spark):
    page = "<ul><li>x{0}</li></ul><p>Always</p><p>Never{0}</p>"
    rows = [(i, "http://a.example/", page.format(i) if i % 2 else page.format(i).replace("<ul>", "<ul><li>a</li>")) for i in range(6)]
    found = html.templates(pages(spark, rows)).collect()
    once = next(r for r in found if "ul" in r.labels)
    many = next(r for r in found if "li" in r.labels)
    assert many.nested_in == once["class"] and "text" in once.labels and all(r.n_pages == 6 for r in (once, many))


def test_defined_cases(spark):
    same = "<article><p>Same story</p></article>"
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain & simple"), (4, "http://h.example", same), (5, "http://h.example", same), (5, "http://h.example", same), (6, "http://h.example", "<article><p>cut &am"), (7, "http://h.example", "<p>a</p" ), (8, "http://h.example", "<article>" + "<p>word &amp; word</p>" * 20000)]
    df = pages(spark, rows).withColumn("main_text", F.lit(1))
    found = texts(df)
    assert [found[i] for i in range(1, 8)] == ["", "", "plain & simple", "Same story", "Same story", "cut &am", "a"]
    assert found[8].count("\n") == 19999
    assert html.extract(df).count() == 9 and html.extract(df.limit(0)).count() == 0


def test_template_inside_articles_is_dropped_and_copies_stay(spark):
    """Notices and share bars under neutral classes go; copies and near copies of an article on their host stay whole."""
    page = '<main><div class="x1">You are reading our daily letter for friends</div><h1>Title {0}</h1><p>Story {0} of a day in {0}</p><div class="x2"><span>Send to a friend</span><p>Print this page</p></div></main>'
    copy = ["The fox went over long hills", "It rained for seventeen days there", "Nobody in townsquare knew why", "Then everything ended well enough"]
    edited = lambda i: "<article>" + "".join(f"<p>{p} {'now' * (i % 4 == k)}{i if i % 4 == k else ''}</p>" for k, p in enumerate(copy)) + "</article>"
    rows = [(i, "http://a.example/", page.format(f"w{i}")) for i in range(8)]
    rows += [(20 + i, "http://b.example/", "<article>" + "".join(f"<p>{p}</p>" for p in copy) + "</article>") for i in range(6)]
    rows += [(40 + i, "http://c.example/", edited(i)) for i in range(8)]
    rows += [(60 + i, "http://d.example/", f"<article><p>Quoted line of both</p><p>Own {i} text {i}</p></article>") for i in range(2)]
    found = texts(pages(spark, rows))
    assert all(found[i] == f"Title w{i}\nStory w{i} of a day in w{i}" for i in range(8))
    assert all(found[20 + i] == "\n".join(copy) for i in range(6))
    assert all(found[40 + i].count("\n") == 3 for i in range(8))
    assert all(found[60 + i] == f"Quoted line of both\nOwn {i} text {i}" for i in range(2))


def test_an_article_in_a_div_keeps_its_short_parts():
    prose = "".join(f"<p>Paragraph {k} goes on for a good number of words.</p>" for k in range(50))
    parts = "<h1>Title</h1><h2>Part</h2>", "<ul><li>one<li>two</ul><blockquote>Quote</blockquote><pre>code</pre><table><tr><th>head<td>cell</table><div><p>Last</p></div>"
    page = f"<body><div><ul><li><a href=x>Another story</a></ul></div><div><div>{parts[0]}{prose}{parts[1]}</div></div></body>"
    lines = html.Page(page).main_text(set()).split("\n")
    assert lines[:2] == ["Title", "Part"] and lines[52:] == ["one", "two", "Quote", "code", "head", "cell", "Last"] and len(lines) == 59
    assert html.Page(f"<h1><a>Linked title</a></h1><div>{prose}</div>").main_text(set()).startswith("Linked title\nParagraph 0")
    assert html.Page("<div><a>Only</a></div><p><a>links</a></p>").main_text(set()) == "Only\nlinks"


def _own(source):
    return html.read_page(source).main_text(set())


def test_classes_that_hold_the_article_do_not_empty_the_page():
    article = "<article><h1>Title</h1><p>Body text.</p></article>"
    menu = "<div class='sidebar'><p>Side</p></div>"
    for wrap in ('class="content no-sidebar"', 'id="page" class="has-sidebar"', 'class="header-page"', 'id="search-page"'):
        assert _own(f"<body><div {wrap}>{article}{menu}</div></body>") == "Title\nBody text."
        assert _own(f"<body><div {wrap}><main><p>Body text.</p></main>{menu}</div>") == "Body text."
    assert _own('<article class="post comment-status-open"><p>Body.</p></article>') == "Body."
    assert _own(f'{article}<div class="related"><article><p>Other story</p></article></div>') == "Title\nBody text."
    assert _own(f'{article}<div class="comments"><article class="comment"><p>First!</p></article></div>') == "Title\nBody text."
    assert _own('<div class="comments"><article class="comment"><p>First!</p></article></div><div><p>The long text of the page itself.</p></div>') == "The long text of the page itself."
    assert _own(f'<div class="social-frame"><div><p>{"Long text. " * 9}</p></div></div><p>Short</p>') == ("Long text. " * 9).strip() + "\nShort"
    assert _own(f"<aside>{article}</aside><p>Open</p>") == "Open"


def test_string_ids_and_clashing_columns(spark):
    rows = [(f"p{k}", "http://h/x", f"<div><p>Notice of the host</p><article><p>Text {k}</p></article></div>") for k in range(4)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").selectExpr("*", "1 AS template_host", "2 AS Template_Tokens", "3 AS main_text")
    out = html.extract(df)
    assert {(r.page_id, r.main_text, r.template_host, r.Template_Tokens) for r in out.collect()} == {(f"p{k}", f"Text {k}", 1, 2) for k in range(4)}


def test_pages_are_read_once_for_the_template(spark):
    """Three steps need the tokens of all pages; nothing reads pages again, and the extraction reads them a second time only."""
    df = pages(spark, [(i, "https://a.org/x", f"<nav>Home</nav><article><p>Text {i} of its own.</p></article>") for i in range(6)])
    assert "MapInArrow" not in html.templates(df)._jdf.queryExecution().executedPlan().toString()
    assert html.extract(df)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
