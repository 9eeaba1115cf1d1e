import time

import numpy as np
import pytest

from ranklab.llm import extract as ex


def texts(page):
    return [t for _, t, _ in ex.blocks(page)]


def test_blocks_tolerate_markup():
    assert texts("<p>a<p>b <b>c<br>d</b>e<div>f</div>g") == ["a", "b c de", "f", "g"]
    assert texts("<ul><li>x<li>y &amp; z</ul>") == ["x", "y & z"]
    assert texts('<script>var t="</p><p>no";</script><style>p{}</style><!-- <p>no</p> --><title>no</title><p title="a>b">yes') == ["yes"]
    assert texts("1 < 2 and <b>3</b> > 2") == ["1 < 2 and 3 > 2"]
    assert texts("<p>&eacute;&#233;&#xe9;&nbsp; x\n\t y</p><!-- cut") == ["ééé x y"]
    assert texts("<script>never closed <p>no") == [] and texts("") == [] and texts("<p></p><a href='x") == []
    assert texts("<p>one</div></span>two</p>") == ["one", "two"]
    assert ex.blocks("<nav class='top-menu'><a href=x>Home</a></nav>")[0][0][0] == ("nav", ".top", ".menu")


def test_nothing_else_is_left_out():
    assert texts("<p>one <svg class='i'/> two</p><p>three <math/></p><p>four</p>") == ["one two", "three", "four"]
    assert texts("<article><p><object data=x>one</p><p>two</p></article><p>three") == ["one", "two", "three"]
    assert texts("<object-viewer>one</object-viewer><title-bar>two</title-bar><p>three") == ["onetwo", "three"]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b <object>c</object><noscript>d</noscript></p>") == ["a x=1 b cd"]
    assert texts("<svg><title>no</title><style>no</style><text>yes</text></svg><title>no</title><iframe src=x>no</iframe><p>end") == ["yes", "end"]
    assert texts("<script src='x'/><iframe src='x'/><title/><p>kept") == ["kept"]
    assert texts("<script src=/a/>no</script foo><STYLE\n>no</Style ><p>kept") == ["kept"]


def test_quotes_in_tags():
    assert texts("""<p title="a < b">x<i data-h='<p class="q">no</p>'>y</i></p>""") == ["xy"]
    assert texts("""<p title="a < b"class="c">x</p><p title="1 > 0" hidden/>y""") == ["x", "y"]
    assert texts("""<p title='it's'>one</p><p alt="5" tall">two</p><p ">three</p>""") == ["one", "two", "three"]
    assert texts("""<p><a href="x>one</a> "two" <a href="y">three</a></p>""") == ['one "two" three']
    assert texts("1 <b and c <p>x") == ["1 <b and c", "x"]


def test_tags_take_linear_time():
    for part in ("""<a x="<a " """, "<a x='", '<a x="<', "<iframe ", "<a \"'", '=""<b ="'):
        start = time.process_time()
        ex.blocks("<p>" + part * 40_000 + "<p>end")
        ex.blocks("<p " + part * 40_000)
        assert time.process_time() - start < 10


def test_links_share():
    assert [k for _, _, k in ex.blocks("<p><a>all</a></p><p>no<a>ne</a></p>")] == [1.0, 0.5]


def test_gradients():
    """Back-propagation against differences, on a padded batch."""
    r = np.random.default_rng(0)
    old = ex.HIDDEN
    try:
        ex.HIDDEN = 3
        h = 3
        model = [r.normal(size=s).astype(np.float64) * .5 for s in ((4, 4 * h), (h, 4 * h), (4 * h,)) * 2 + ((2 * h,), (1,))]
        x, mask = ex._stack([r.normal(size=(5, 4)), r.normal(size=(2, 4))])
        x, y = x.astype(np.float64), (r.random(mask.shape) > .5).astype(float)

        def loss():
            z = ex._logits(model, x, mask)[0]
            return (np.log1p(np.exp(z)) - y * z)[mask].sum()
        z, hs, tf, tb = ex._logits(model, x, mask, keep=True)
        dz = np.where(mask, ex._sigmoid(z) - y, 0)
        dh = dz[:, :, None] * model[6]
        grads = [*ex._backward(dh[:, :, :h], x, tf, model[1]), *ex._backward(dh[::-1, :, h:], x[::-1], tb, model[4])]
        for p, g in zip(model, grads):
            for i in list(np.ndindex(p.shape))[::7]:
                p[i] += 1e-3
                up = loss()
                p[i] -= 2e-3
                down = loss()
                p[i] += 1e-3
                assert abs((up - down) / 2e-3 - g[i]) < 2e-2 + 0.05 * abs(g[i])
    finally:
        ex.HIDDEN = old


def test_held_out_pages():
    model = ex.fitted()
    pages, labels = ex.training_pages(150, 77)
    found = ex.main_blocks(pages, model)
    assert np.mean(np.concatenate(found) == (np.concatenate(labels) > 0)) > 0.985


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header">My site</header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Menu</a></li></ul></nav><div class="cookie-banner">We use cookies to improve this site</div>
<article><h1>The heading &amp; more</h1><p>First  long paragraph of\nthe article. It has sentences, and some more words.</p><p><b>Second one.<br>
<p>Third paragraph with a <a href=x>link</a> inside. And it goes on.</p></article><div class="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot.</p></div></div>
<form><label>Search</label><button>Go</button></form><footer>&copy; 2023 All rights reserved</footer></body></html>"""


def test_query_on_pages(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, None), (3, "u", "", None), (None, "u", PAGE, None), (1, "u", PAGE, "t"),
            (4, "u", "<article>" + "<p>Many words stand in here. They go on and on.</p>" * 5000 + "</article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r for r in ex.main_text(df).collect()}
    assert ex.main_text(df).count() == 6
    want = ("The heading & more\nFirst long paragraph of the article. It has sentences, and some more words.\nSecond one.\n"
            "Third paragraph with a link inside. And it goes on.")
    assert got[1, "u"]["text"] == got[None, "u"]["text"] == want and got[1, "u"]["n_chars"] == len(want)
    assert got[2, None]["text"] == got[3, "u"]["text"] == ""
    assert got[4, "u"]["text"].count("Many words") >= 4990
    assert ex.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, n", [
    ("<div>" * 200_000 + "a", 1), ("<b>" * 100_000 + "</i>" * 200_000 + "x", 1), ("<b>" * 30_000 + "<div></div>x" * 30_000, 30_000),
    ("</1" * 100_000 + "x", 1), ("<ul>" + "<li><div>x" * 40_000, 40_000), ("<div>a" * 60_000, 60_000)])
def test_time_is_linear_in_nesting_and_unmatched_tags(page, n):
    began = time.time()
    assert len(ex.blocks(page)) == n
    assert time.time() - began < 20


def test_deep_pages_are_labelled_in_bounded_pieces():
    pages = [ex.blocks("<div>a" * 20_000), ex.blocks("<article><p>One. Two three.</p></article>")]
    model = ex.fitted()
    whole, cut = ex.main_blocks(pages, model), ex.main_blocks(pages, model, cells=1, chunk=100)
    assert all((a == b).all() for a, b in zip(whole, cut))


@pytest.mark.parametrize("texts", [
    ["これは日本語の記事の最初の段落です。とても長い文章がここに続きます。", "二番目の段落にはもう少し短い文があります。", "三番目の段落です。天気がよいので散歩に出かけました。",
     "四番目の段落では、友人と会って昼食を食べました。", "最後の段落です。家に帰って本を読みました。"],
    ["这是文章的第一段，内容比较长，继续写下去。", "第二段比较短。", "第三段：天气很好，我们出去散步了。", "第四段我们吃了午饭。"],
    ["Первый абзац статьи довольно длинный и продолжается.", "Второй короче.", "В третьем мы вышли на прогулку."],
    ["plain text only without tags"]])
def test_text_of_many_scripts_without_a_wrapper(texts):
    page = "".join(f"<p>{x}</p>" for x in texts) if len(texts) > 1 else texts[0]
    assert ex.main_blocks([ex.blocks(page)], ex.fitted())[0].all()
