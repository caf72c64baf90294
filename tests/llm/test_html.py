import itertools

import numpy as np
import pytest

from quarry.llm import html_main as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(spark.read.parquet(f"{SF}/pages.parquet"), layout_pages=500)


def test_messages_equal_enumeration():
    rng = np.random.default_rng(1)
    pages = [H.Page("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>"), H.Page("<h1>x</h1>")]
    forest = H.Forest(pages)
    n = len(forest.parent)
    own, pair = rng.normal(size=(n, 2)), rng.normal(size=(H.N_KINDS, 2, 2))
    marginal, joint, _ = H.sum_product(forest, own, pair)
    for a, z in zip(forest.begin[:-1], forest.begin[1:]):
        nodes, total = list(range(a, z)), 0.0
        want, want_joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for x in itertools.product((0, 1), repeat=len(nodes)):
            y = dict(zip(nodes, x))
            s = sum(own[i, y[i]] for i in nodes) + sum(pair[forest.kind[i], y[forest.parent[i]], y[i]] for i in nodes[1:])
            p = np.exp(s)
            total += p
            for i in nodes:
                want[i, y[i]] += p
            for i in nodes[1:]:
                want_joint[i, y[forest.parent[i]], y[i]] += p
        assert np.allclose(marginal[a:z], want[a:z] / total)
        assert np.allclose(joint[a + 1 : z], want_joint[a + 1 : z] / total)


def runs(source):
    return [t for _, t in H.Page(source).runs]


def test_parsing():
    assert runs("<p>a <b>b</b>\n c&amp;d<br>e<p>f") == ["a b c&d e", "f"]
    assert runs("<script>var t='</p>';</script><!-- x --><style>p{}</style><p>a") == ["a"]
    assert runs("<head><title>t</title></head><body><ul><li>a<li>b</ul></div></body>") == ["a", "b"]
    assert runs('<div title="a>b" hidden>no</div><div title="unclosed>x</div>yes <p') == ["x", "yes"]
    assert runs("plain &lt;text&gt;  with\tspace") == ["plain <text> with space"]
    assert runs("") == [] and runs("<p></p>") == []
    assert len(runs("<div>" * 3000 + "deep")) == 1


def test_stray_quotes_and_cut_references():
    assert runs("<p>a</p><p don't>b</p><p>it's c</p><p>d</p>") == ["a", "b", "it's c", "d"]
    assert runs("<p>a</p><p \">b</p><p>c</p><p class='x\"y'>d\"</p>") == ["a", "b", "c", 'd"']
    assert runs("<p title = 'a>b' x=\"c>'d\">e</p><p title=it's>f</p><p>g'h</p>") == ["e", "f", "g'h"]
    assert runs("<p title=\"never closed>a</p><p>b</p>") == ["a", "b"]
    assert runs("<p \"hidden\">a</p><p don't hidden>no</p><p data-x='hidden'>b</p>") == ["a", "b"]
    assert runs("<p>&am<b>p;</b> &amp;<i>lt;</i> &l<!-- x -->t;</p>") == ["&amp; &lt; &lt;"]
    assert runs("<p>&amp;amp; <b>&eacute;</b>&#65;</p><xmp>&amp; <b></xmp>&lt;") == ["&amp; \u00e9A", "&amp; <b>", "<"]
    long = "<p a=b " + "x'y \" " * 50_000 + ">t</p>"
    assert runs(long * 4) == ["t"] * 4


def test_extraction(spark, model):
    article = "<article><h1>Title here</h1><p>First &eacute; paragraph of the story, long enough to read.</p><p>Second   one\nwith more of the same story.</p></article>"
    page = (
        "<html><head><title>t</title><script>x()</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
        f"<div class='cookie-notice'><p>We use cookies.</p><button>OK</button></div>{article}"
        "<aside class='sidebar'><h4>Related</h4><ul><li><a href='/c'>Other</a></li></ul></aside>"
        "<section class='comments'><h3>Comments</h3><p>Nice one!</p></section><form><label>Mail</label><button>Go</button></form><footer>&copy; me</footer></body></html>"
    )
    text = "Title here\nFirst é paragraph of the story, long enough to read.\nSecond one with more of the same story."
    rows = [(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (1, "u", page, 5), (None, "u", "<nav><a>x</a></nav>", 5), (4, "u", "just text", 5), (5, "u", page.replace("Second", "Second " * 40_000), 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.extract(df, model).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[1].text == text and by[1].n_chars == len(text) and sum(r.page_id == 1 for r in got) == 2
    assert by[2].text == "" and by[2].n_chars == 0 and by[3].text == ""
    assert by[4].text == "just text" and by[5].text.count("Second") == 40_000


def test_given_pages(spark, model):
    """The article of every given page, cut out by its own tags, is the extracted text."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages, model).collect()}
    wrong = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", ""))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        wrong += got[r.page_id] != "\n".join(b for b in blocks if b)
    assert wrong == 0


def test_held_out_layouts(model):
    import re

    sentences = ["One plain sentence of some words", "Another sentence that is a bit longer than that", "Short words again here"]
    same = n = 0
    for s in H.layouts(sentences, 150, 77)[0]:
        page, labels = H._marked(s)
        want = "\n".join(t for i, t in page.runs if labels[i])
        same += H.content(model, [re.sub(r"[\1-\4]", "", s)])[0] == want
        n += 1
    assert same / n > 0.8


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    model = H.fit(empty, layout_pages=60)
    assert H.extract(empty, model).collect() == []


def test_only_the_page_itself_hides_text():
    for shown in (
        '<article class="prose hidden md:block">a</article>',
        '<article data-title="The hidden cost of cheap bread">a</article>',
        '<div style="overflow: hidden !important">a</div>',
        '<div data-style="display:none" data-hidden="1" aria-hidden="false">a</div>',
        '<div title="set display: none or aria-hidden=true">a</div>',
        '<div style="display:none; display: block">a</div>',
        '<section hidden="until-found">a</section>',
    ):
        assert runs(shown) == ["a"], shown
    for hidden in ("hidden", "HIDDEN=''", 'class="x" hidden="hidden"', "aria-hidden='true'", "aria-hidden=true", 'style="color:red;DISPLAY : none !important; display:block"', "style=display:none"):
        assert runs(f"<div {hidden}><p>a</p></div><p>b</p>") == ["b"], hidden
    assert H.Page('<div data-id="menu" ID=top class="post main">a</div>').names[1] == ("c=top", "c=post", "c=main")


def test_math_object_xmp_and_unclosed_elements():
    assert runs("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds<p>b <object data=f><param name=p>shown</object> c</article>") == ["so x=1 holds", "b shown c"]
    assert runs("<p>a<xmp>if <b>x</b> &amp; y</xmp>z") == ["a", "if <b>x</b> &amp; y", "z"]
    for tag in ("svg", "iframe", "noscript", "template", "textarea", "object", "math"):
        assert runs(f"<article><p>a</p><{tag}><p>b</p></article><p>c</p>") == ["a", "b", "c"], tag
    assert runs("<article><p>a</p><div><script>x('<div></div>')</div><p>b</p></article>") == ["a", "b"]
    assert runs("<article><p>a</p><xmp><i></article><p>c") == ["a", "<i>", "c"]
    assert runs("<head><title>t</head><body><p>a") == ["a"] and runs("<head><style>p{}<body><p>a") == ["a"]
    assert runs("<p>a<svg/>b<svg-icon>c</svg-icon>d<svg><text>no</text></svg>") == ["abcd"]


def test_article_with_hidden_in_a_value_is_extracted(model):
    body = "<h1>Title here</h1><p>First paragraph of the story, long enough to read.</p><p>Second one with more of the same story.</p>"
    texts = H.content(model, [f"<html><body><nav><a href='/'>Home</a></nav><article {a}>{body}</article><footer>me</footer></body></html>" for a in ("", 'data-title="The hidden cost of bread"', 'style="overflow: hidden !important"')])
    assert "Second one with" in texts[0] and texts[0] == texts[1] == texts[2]
