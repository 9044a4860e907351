import pytest

from codeloupe.llm import main_text as m

LONG = "This sentence is long enough to count, with a comma or two, so that it scores."
PAGES = {
    "plain": (f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>{LONG} Two.</p></article><footer>(c)</footer></body></html>", f"Title\n{LONG}\n{LONG} Two."),
    "unclosed": (f"<body><div class=ad>Buy now, today</div><article><h1>T</h1><p><b>{LONG}<br><p>Short.<p>{LONG}</article><footer>x", f"T\n{LONG}\nShort.\n{LONG}"),
    "chrome": (
        f"""<div class="cookie-notice"><p>{LONG}</p></div><header><h1>Site</h1></header><aside><p>{LONG}</p></aside><div id="content"><h1>T</h1><p>{LONG}</p><form><p>{LONG}</p></form>
        <div class="ad-box"><p>{LONG}</p></div><div><p>{LONG} Nested.</p></div><ul><li>one</li><li>two</ul><div id="comments"><p>{LONG}</p></div></div><div class="sidebar"><p>{LONG}</p></div>""",
        f"T\n{LONG}\n{LONG} Nested.\none\ntwo",
    ),
    "references": (f"<article><p>A &amp; b &eacute;&#8212;&#x41; &notit; &lt;p&gt; {LONG}</p></article>", f"A & b é—A ¬it; <p> {LONG}"),
    "white space": (f"<article><p>a\n\t b&nbsp; <i>c</i>d <!-- x > y --> {LONG}</p><pre>{LONG}  e\n f</pre></article>", f"a b cd {LONG}\n{LONG} e f"),
    "scripts": (f"<article><script>var t='</p><p>no';</script><style>p{{}}</style><p>{LONG}</p><noscript><p>{LONG}</p></noscript></article>", LONG),
    "sections": (f"<main><section><p>{LONG}</p></section><section><p>{LONG} 2</p></section></main><div><p>{LONG}</p></div>", f"{LONG}\n{LONG} 2"),
    "heading in a header": (f"<article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG}"),
    "links": (f"<div><p>{LONG}</p></div><div>{'<a href=x>A link text, long enough</a> ' * 9}</div>", LONG),
    "empty": ("", ""),
    "no text": ("<html><body><div></div></body></html>", ""),
    "only a tag": ("<article", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert m.main_text(PAGES[name][0]) == PAGES[name][1]


def test_deep_and_long_pages():
    assert m.main_text("<div>" * 3000 + f"<p>{LONG}</p>") == LONG
    assert m.main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").count("\n") == 4999


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGES["plain"][0], 5), (2, None, None, 5), (2, None, None, 5), (None, "v", "", 5)], "page_id long, url string, html string, n_chars long")
    found = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in m.extract(df).collect())
    assert found == [("1", "u", PAGES["plain"][1], len(PAGES["plain"][1])), ("2", "None", "", 0), ("2", "None", "", 0), ("None", "v", "", 0)]
    assert m.extract(df.limit(0)).count() == 0
