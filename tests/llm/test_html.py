import random
import time

import pytest

from anchorage.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>{before}<main><article>{article}</article></main>{after}<script>var a = "<p>no</p>";</script></body></html>"""
NOISE = [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News, and more</a></ul></nav>", "<header><p>Site name, the best, of all, sites, in the world, really</p></header>", "<aside><p>Related, many, things, here, that nobody, reads, at all</p></aside>",
    "<footer>&copy; all, rights, reserved</footer>", '<div class="cookie-notice"><p>We use cookies, and so, do you, accept, please, now</p></div>', '<div id=ad-1 class="advert top"><p>Buy, this, great, thing, today, at once</p></div>',
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>Great, article, thanks, a lot, for, writing this</p></div></section>', "<form><label>Mail <input name=a></label><button>Go</button></form>", "<!-- a comment <p>no</p> -->", "<noscript><p>Turn on, scripts</p></noscript>",
    '<div hidden><p>Hidden, text, is here, and long, enough, to count</p></div>', '<ul class="menu"><li>One<li>Two</ul>', '<div role="navigation"><p>Here, you, are, in, the, tree</p></div>', "<iframe src=x><p>no</p></iframe>",
]


def sentence(r):
    return " ".join(r.choice(["word", "thing,", "éa", "house", "&amp;", "runs", "far,"]) for _ in range(r.randint(8, 60))) + "."


def page(r):
    blocks, want = [], []
    for _ in range(r.randint(1, 8)):
        s = sentence(r)
        kind = r.choice(["p", "p", "p", "h2", "ul", "quote", "inline", "open"])
        plain = s.replace("&amp;", "&")
        if kind == "ul":
            blocks.append(f"<ul><li>{s}<li> {s} </ul>")
            want += [plain, plain]
        elif kind == "inline":
            blocks.append(f"<p> <b>{s}</b>\n\t<a href='x'>link</a>&nbsp;<i>end</i></p>")
            want.append(f"{plain} link end")
        else:
            tag = {"h2": "h2", "quote": "blockquote"}.get(kind, "p")
            blocks.append(f"<{tag}>{s}" + ("" if kind == "open" else f"</{tag}>"))
            want.append(plain)
    inner = [x for b in blocks for x in (b, r.choice(NOISE) if r.random() < 0.2 else "")]
    around = r.sample(NOISE, r.randint(0, 6))
    cut = r.randint(0, len(around))
    return PAGE.replace("{before}", "".join(around[:cut])).replace("{after}", "".join(around[cut:])).replace("{article}", "".join(inner)), " ".join(want)


@pytest.mark.parametrize("seed", range(60))
def test_article_and_nothing_else(seed):
    made, want = page(random.Random(seed))
    assert html.main_text(made) == want


def test_articles_without_the_element():
    body = "<div id=top><a href=1>a</a> <a href=2>b</a></div><div class=story><h1>Title</h1><p>" + "Long text, with commas, and more. " * 5 + "</p><p>" + "And so on, and on. " * 6 + "</p></div><div class=links><a href=3>Other things, to read, here</a></div>"
    got = html.main_text(f"<html><body>{body}</body></html>")
    assert got.startswith("Title Long text") and got.endswith("And so on, and on.") and "Other" not in got


LONG = "Long text, with commas, and more, that goes on for quite a while. " * 8


def test_nothing_of_an_article_is_lost_beside_its_longest_part():
    few = "Few words, some commas, here. " * 10
    for tag in ("article", "main"):
        made = f"<body><{tag}><section>{f'<p>{LONG}</p>' * 6}</section><section><p>{few}</p></section><div><div><h4>Head</h4><p>short</p></div></div></{tag}></body>"
        assert html.main_text(made) == " ".join([*[LONG.strip()] * 6, few.strip(), "Head", "short"])
    made = f"<main><p>lead</p><div><div>intro</div><article><section>{f'<p>{LONG}</p>' * 6}</section><p>end</p></article></div><ul><li><a href=1>Other things, to read, here</a></ul></main>"
    assert html.main_text(made) == " ".join(["lead", "intro", *[LONG.strip()] * 6, "end"])


def test_nothing_is_lost_beside_a_container():
    beside = ["<div>Intro</div>", "<h3>Third</h3>", "<h6>Sixth</h6>", "<ul><li>item</ul>", "<blockquote>quote</blockquote>", "<pre>code</pre>", "<table><tr><td>cell</table>", "<p>no comma</p>", "bare <b>bold</b>, <a href=1>x</a> text"]
    want = ["Intro", "Third", "Sixth", "item", "quote", "code", "cell", "no comma", "bare bold, x text"]
    links = "<div><a href=3>Other things, to read, here</a></div>"
    got = html.main_text(f"<body><div>{links}<div>{''.join(beside)}<div>{f'<p>{LONG}</p>' * 6}</div>{links}{''.join(beside)}</div></div></body>")
    assert got == " ".join([*want, *[LONG.strip()] * 6, *want])


@pytest.mark.parametrize("text", ["", "<", "<p", "<p>", "</p></div>", "<script>x", "<!--", "<a href='x>y", "<p a=\"1>x</p>", "&#0;&bogus;&amp", "<table><td>a<td>b", "<![CDATA[x]]>", "<div>" * 3000 + "deep", "<p>" * 5000, "<li>" * 3000])
def test_broken_pages(text):
    assert isinstance(html.main_text(text), str)


def test_stray_quotes_stay_in_their_tag():
    assert html.main_text('<article><p class=foo">Text here.</p><p title="a > b">More, "quoted" text.</p><p a=\'x">And</p><b"c>this</b></article>') == 'Text here. More, "quoted" text. And this'
    assert html.main_text('<p a="1>x</p>') == "x"


def test_comments_marked_up_as_articles():
    said = "Nice, text, thank you, all, for this one. " * 9
    for attributes in ('class="comment"', 'class="comment-body" id="div-comment-5"', 'id=comment-17', 'class="reply depth-2"'):
        made = f"<article class='post hentry comments-open'><h1>Head</h1>{f'<p>{LONG}</p>' * 3}<article {attributes}><p>{said}</p></article></article>"
        assert html.main_text(made) == " ".join(["Head", *[LONG.strip()] * 3])


def test_class_words_in_the_names_of_paragraphs():
    kept = "Some words on tags, skips, and other things of the kind. "
    for name in ("tags-explained", "skip-logic", "social-history", "notice-of-motion", "related-work"):
        assert html.main_text(f'<article><p>{LONG}</p><p class="{name}">{kept}</p><h2 id="{name}">Head</h2></article>') == f"{LONG.strip()} {kept.strip()} Head"
    for name in ("ad", "advert text", "share-buttons", "cookie-notice", "tags"):
        assert html.main_text(f'<article><p>{LONG}</p><p class="{name}">{kept}</p></article>') == LONG.strip()


def test_hidden_parts_and_notices():
    for part in ('<span class="sr-only">Hidden words here</span>', '<div class="alert alert-info">We, are, closed, today, and, tomorrow, too</div>', '<div class="gdpr box"><p>Your, data, is, yours</p></div>', '<ul class="pagination"><li>1<li>2</ul>'):
        assert html.main_text(f"<article><p>{LONG}</p>{part}<p>End</p></article>") == f"{LONG.strip()} End"


def test_end_tags_take_linear_time():
    for made in ("<span>" * 16_000 + "</b>" * 16_000, "<b>" * 16_000 + "<div>" + "<span>" * 16_000 + "</b>" * 16_000, "<span>" * 16_000 + "<p>x" * 16_000, "<div>" * 16_000 + "</section>" * 16_000):
        start = time.monotonic()
        html.main_text(f"<article>{made} text</article>")
        assert time.monotonic() - start < 1.5


def test_unclosed_header_ends_with_its_article():
    made = "<article><header><h1>Head</h1><p>by me</article><div class=post><p>" + "Text, that goes on, for a while. " * 4 + "</div>"
    assert "Text, that" in html.main_text(made) and "by me" not in html.main_text(made)


def test_long_pages_are_read_whole():
    made = "<article>" + "<p>Some words, here.</p>" * 20_000 + "</article>"
    assert html.main_text(made) == " ".join(["Some words, here."] * 20_000)


def test_odd_rows(spark):
    rows = [(1, "u", "<p>Hello <b>there</b></p>"), (None, None, None), (2, "u", ""), (1, "u", "<p>Hello <b>there</b></p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n_chars", "'t' as text")
    got = sorted(map(tuple, html.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", "Hello there", 11), (None, None, "", 0), (2, "u", "", 0), (1, "u", "Hello there", 11)], key=repr)
    assert html.extract(df.limit(0)).count() == 0
