"""HTML extraction: messages against enumeration, whole pages against their known articles, broken markup."""

import html
import itertools
import re

import numpy as np
import pytest

from sentrel.llm import extract, queries


@pytest.fixture(scope="module")
def model(spark):
    return extract.train(queries.table(spark, "/root/testdata/sf0.001", "pages"))


def article(source):
    m = re.search(r"<article>(.*?)</article>", source, re.DOTALL)
    body = re.sub(r"</?(p|h1)[^>]*>", "\0", re.sub("<br>", " ", m[1]))
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in body.split("\0"))
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = queries.table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in queries.op5_extract(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_messages_match_enumeration():
    pages = [extract.Page("<body><div class=ad><p>x.</p><p>y</p></div><article><h1>t</h1></article></body>"), extract.Page("z")]
    forest = extract.Forest(pages)
    draw = np.random.default_rng(1)
    unary, pair = draw.normal(size=len(forest.parent)), draw.normal(size=(extract.KINDS, 2, 2))
    p, both, log_z = forest.marginals(unary, pair)
    n = len(forest.parent)
    total, one, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for state in itertools.product((0, 1), repeat=n):
        score = sum(unary[i] * state[i] for i in range(n)) + sum(pair[forest.kind[i], state[forest.parent[i]], state[i]] for i in range(n) if forest.parent[i] >= 0)
        e = np.exp(score)
        total += e
        for i in range(n):
            one[i] += e * state[i]
            if forest.parent[i] >= 0:
                joint[i, state[forest.parent[i]], state[i]] += e
    assert np.allclose(p, one / total) and np.allclose(both, joint / total) and np.isclose(log_z, np.log(total))


@pytest.mark.parametrize("style, least", [("cues", 185), ("plain", 170), ("none", 170)])
def test_labelled_pages_held_out(model, style, least):
    """Pages that the model has not seen; those of the last two styles name no part."""
    pages = extract.built_pages(200, 77, (style,))
    bare = model.texts([re.sub(r'\sdata-label="?[01]"?', "", p) for p in pages])
    right = 0
    for source, got in zip(pages, bare, strict=True):
        p = extract.Page(source)
        right += got == p.text(extract.labels_of(p).astype(bool))
    assert right >= least


def test_labels_of_the_table_need_no_names(spark):
    """What stands together agrees with the known articles, also when the markup names nothing."""
    rows = queries.table(spark, "/root/testdata/sf0.01", "pages").collect()
    right = [0, 0]
    for r in rows:
        for k, source in enumerate((r.html, re.sub(r"<(/?)(article|nav|footer)", r"<\1div", r.html).replace(' class="ad"', ""))):
            page = extract.Page(source)
            right[k] += page.text(extract.prose_labels(page).astype(bool)) == article(r.html)
    print(right)
    assert min(right) > 0.9 * len(rows)


PROSE = "<p>A long enough sentence stands here, and goes on for a while.</p><p>Another one follows it, as sentences in articles do.</p>"
WANT = "A long enough sentence stands here, and goes on for a while.\n\nAnother one follows it, as sentences in articles do."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article>{PROSE}<p>Let <math><mi>x</mi></math> be a number.</p></article>", WANT + "\n\nLet x be a number."),
        (f"<article><div><svg><path d='m'></div>{PROSE}</article>", WANT),
        (f"<article><p><svg><text>no</text>{PROSE}</article>", WANT),
        (f"<article><svg><path d='m'>{PROSE}</article>", WANT),
        (f"<article><svg><text>no<foreignObject><p>nor this</p></foreignObject></svg>{PROSE}</article>", WANT),
        (f'<article id="social-history">{PROSE}</article>', WANT),
        (f'<article class="post contact-report">{PROSE}</article>', WANT),
        (f'<body class="page sidebar-left"><nav><a href=/>Home</a></nav><article><h2 id="related-work">Work of others</h2>{PROSE}<h2 id="discussion">What it means</h2>{PROSE}</article>', f"Work of others\n\n{WANT}\n\nWhat it means\n\n{WANT}"),
        (f"<article><header><h1>The title of it</h1></header>{PROSE}</article>", "The title of it\n\n" + WANT),
        (f'<article>{PROSE}<p class="message">The message reads so, and this was all.</p></article>', WANT + "\n\nThe message reads so, and this was all."),
        (f'<article>{PROSE}<p class="printable">It can be printed as well, they say.</p></article>', WANT + "\n\nIt can be printed as well, they say."),
        (f'<article>{PROSE}<p><img alt="a<b>c">Seen in the picture above, they say.</p></article>', WANT + "\n\nSeen in the picture above, they say."),
        (f'<script src="a.js"/>var hidden = 1;</script><article>{PROSE}</article>', WANT),
        (f"<body><div><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></div><div><h1>The title of it</h1>{PROSE}{PROSE}</div><div><p>Imprint and terms</p></div></body>", "The title of it\n\n" + WANT + "\n\n" + WANT),
    ],
)
def test_odd_markup(model, page, want):
    assert model.texts([page]) == [want]


def test_parts_that_go(model):
    page = """<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script><style>p>a{}</style></head><body>
    <header class="masthead"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div id="cookie-notice"><p>We use cookies. Accept them all.</p></div>
    <article><h1>Fish &amp;\n chips</h1><p>One&nbsp;two <b>th</b>ree, a long enough sentence about frying.<p>Four<br>five &#x41;&lt;b&gt;.<!-- <p>no</p> -->
    <div class="ad">Buy now.</div><aside>Related things to read.</aside><ul><li>first point<li>second point</ul><form><p>Mail me</p></form>
    <section class="comments"><h2>Comments</h2><div class="comment"><p>Great text, thanks.</p></div></section></article><div class="sidebar"><p>Other news of the day is here.</p></div><footer>(c)</footer>"""
    assert model.texts([page]) == ["Fish & chips\n\nOne two three, a long enough sentence about frying.\n\nFour five A<b>.\n\nfirst point\n\nsecond point"]


def test_edges(spark, model):
    deep = "<article><div>" * 3000 + "<p>deep down here it ends.</p>"
    odd = [(1, None, None), (2, "u", ""), (3, None, "<"), (4, "u", "<p"), (5, "u", "</p></p><article><p>a &amp b.</article>"), (6, "u", deep), (None, "u", "<a href='" * 5000), (7, "u", "<script>" + "x" * 1000), (7, "u", "<script>" + "x" * 1000)]
    df = spark.createDataFrame(odd, "page_id long, url string, html string").selectExpr("*", "'k' as text")
    rows = extract.extract(df, model).collect()
    assert len(rows) == len(odd) and {r.page_id: r.text for r in rows if r.page_id in (1, 2, 7)} == {1: "", 2: "", 7: ""}
    assert {r.page_id: r.text for r in rows}[5] == "a & b."
    assert extract.extract(df.limit(0), model).count() == 0
    assert extract.train(df.limit(0)).texts(["<article><p>still a long enough sentence here.</p></article>"]) == ["still a long enough sentence here."]


def test_markup_inside_raw_text_ends_with_it(model):
    text = "<article><p>A long enough sentence stands here.</p></article>"
    for code in ("for(var i=0;i<n;i++){f(i);}", "if(a<b){f()}", 'var s="<!--";', "'<a href=\"'", "x<y"):
        for name in ("script", "STYLE", "title", "textarea"):
            for page in (f"<{name}>{code}</{name}>{text}<{name}>{code}</{name} >", f"<svg><script>{code}</script></svg>{text}<{name}>{code}"):
                assert model.texts([page]) == ["A long enough sentence stands here."], page
    assert model.texts([f"<svg><!-- </svg> --><text>no</text></svg>{text}<script/>"]) == ["A long enough sentence stands here."]
    assert model.texts([f"{text}<script>f()</scripts>" + "</script " * 20000]) == ["A long enough sentence stands here."]
