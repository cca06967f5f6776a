"""Main text: wrappers of several pages, pages alone, and odd markup."""

from hedgewise.llm import html_extract as H


def page(i, body):
    return f"""<html><head><title>T{i}</title><script>var a="<p>x</p>";</script><style>p>a{{}}</style></head>
<body><header class="site-header"><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a>About</a></ul></nav></header>
<div class="cookie-notice">We use cookies</div>
<div id="wrap"><div id="text"><h1>Title {i} &amp; more</h1>{body}<p>Subscribe to our list today</p></div>
<div class="sidebar"><ul><li>Foo {i}</li></ul></div><section id="comments"><p>A long comment of a reader {i}</p></section></div>
<form><label>Search</label></form><footer><p>Copyright &copy;</p></footer></body></html>"""


BODY = (
    "<p>First   para {i}\n with <b>bold</b> text<br>and break.</p><ul><li>one {i}<li>two {i}</ul><p>Next&nbsp;para {i}"
    ' <span class="ad">BUY</span>end.<!-- <p>no</p> --><blockquote>Quote {i}</blockquote>'
)


def test_wrapper_of_a_host(spark):
    rows = [(i, f"http://www.h.example/{i}", page(i, BODY.format(i=i))) for i in range(8)]
    rows += [(90, None, None), (91, "", ""), (92, "http://alone.example", page(7, BODY.format(i=7)))]
    frame = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumn
    found = {r.page_id: r for r in H.extracted(frame("host", H.F.lit("clash"))).collect()}
    for i in range(8):
        want = f"Title {i} & more|First para {i} with bold text and break.|one {i}|two {i}|Next para {i} end.|Quote {i}"
        assert found[i].text == want.replace("|", "\n") and found[i].n_chars == len(want)
    assert found[90].text == found[91].text == ""
    # a page alone has nothing to be told from
    assert found[92].text.endswith("Quote 7\nSubscribe to our list today")
    assert H.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_article_wins_and_its_header_gives_the_heading():
    text = "<body><div>menu</div><article><header><h1>Head</h1><p>by x</p></header><p>A<p>B<aside>no</aside>tail</article>"
    assert H.main_text(text + "<div>" + "after " * 9 + "</div>", None, frozenset()) == "Head\nA\nB\ntail"


def test_odd_markup():
    assert H.main_text("<<<<<p>x &lt;b&gt; y</p>", None, frozenset()) == "<<<<\nx <b> y"
    assert H.main_text("plain only &amp", None, frozenset()) == "plain only &"
    assert H.main_text("<div>" * 5000 + "x" + "</div>" * 5000, None, frozenset()) == "x"
    assert isinstance(H.main_text('<a b="' * 3000, None, frozenset()), str)


def test_merge_is_by_order_and_counts_pages():
    a = H.wrapper(H.parsed("<div><h1>t</h1><p>x</p><p>y</p></div>"))
    b = H.wrapper(H.parsed("<div><p>x</p><table><tr><td>z</table></div>"))
    assert H.similarity(a, b) == 3  # html, div, p
    H.merge(a, b)
    div = a[H.CHILDREN][0]
    assert [c[H.KEY] for c in div[H.CHILDREN]] == ["h1", "p", "table"] and div[H.CHILDREN][1][H.PAGES] == 2
    assert div[H.CHILDREN][1][H.TEXTS][str(H.mark("x"))] == 2


def test_repeated_lines_are_told_from_long_articles(spark):
    rows = []
    for i in range(20):
        own = [f"Paragraph {k} of page {i}" for k in range(40)]
        body = "".join(f"<p>{x}</p>" for x in [*own[:20], "A line of every page", *own[20:]])
        more = "<p>On half of the pages</p>" if i % 2 else ""
        rows.append((i, f"http://long.example/{i}", f"<body><article><h1>T {i}</h1>{body}{more}<p>Read on</p></article></body>"))
    found = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    for r in found:
        want = [f"T {r.page_id}", *(f"Paragraph {k} of page {r.page_id}" for k in range(40))]
        assert r.text.split("\n") == want + ["On half of the pages"] * (r.page_id % 2)


def test_deep_elements_close_their_own_and_stay_apart():
    deep = "<div>" * 150 + "<p>low<p>lower<nav><div>menu</div></nav><div>lowest</div>end" + "</div>" * 150
    page = f"<body><div class=content><h1>T</h1><article><p>first</p>{deep}<p>after</p></article></div><div class=sidebar>no</div></body>"
    assert H.main_text(page, None, frozenset()) == "first\nlow\nlower\nlowest\nend\nafter"
    # closing tags of what is too deep leave the outer elements open, for any number of them
    assert H.main_text("<article>" + "<div>" * 3000 + "x" + "</div>" * 3000 + "<p>y</p><p>z</article>", None, frozenset()) == "x\ny\nz"
