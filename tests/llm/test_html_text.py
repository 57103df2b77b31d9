import random

import pytest

from quadweave.llm import html_text
from quadweave.llm.html_text import blocks_of, default_tree, extract_text, main_text


def text(html):
    return main_text(html, default_tree())


PARTS = {
    "menu": '<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta news</a></li></ul></nav>',
    "header": "<header><h2>The Daily Thing</h2><p>Since long ago, every day, for all who want to read it here.</p></header>",
    "footer": "<footer><p>&copy; thing.example.com, all rights of every kind reserved by us</p></footer>",
    "sidebar": '<aside class="sidebar"><h3>Popular</h3><p>Some teaser with quite a few words that nobody asked for.</p></aside>',
    "named sidebar": '<div id="sidebar-right"><p>Some teaser with quite a few words that nobody asked for at all.</p></div>',
    "notice": '<div class="cookie-banner"><p>We and our partners store cookies on your device to do many things.</p></div>',
    "advert": '<div class="ad">Buy one now and get a second one for half of the usual price.</div>',
    "form": "<form><label>Mail</label><input type=text><p>Sign up to our letter now and read more of it every day.</p><button>Go</button></form>",
    "script": '<script>var t="</p>"; if (1 < 2) { track("words in a script") }</script><style>p { margin: 0 }</style>',
    "comments": '<section id="comments"><h3>Readers say</h3><article class="comment"><p>I do not agree with a single word of this, sorry to say.</p></article></section>',
    "comment": "<!-- a comment of markup -->",
}
BODY = ["<h1>A title</h1>", "<p>One paragraph with <b>bold</b> and <a href='#'>a link</a> in it, long enough to be text.</p>", "<p>Of.</p>", "<ul><li>first</li><li>second</li></ul>", "<p>Left open<p>And the next &amp; last &lt;one&gt; caf&eacute;&#33;", "<blockquote>Quoted\n\t words</blockquote>"]
WANT = ["A title", "One paragraph with bold and a link in it, long enough to be text.", "Of.", "first second", "Left open And the next & last <one> café!", "Quoted words"]


@pytest.mark.parametrize("seed", range(40))
def test_articles_come_out_whole_and_alone(seed):
    """Pages put together at random, not used for training; the expected text is known."""
    rng = random.Random(seed)
    picked = [i for i in range(len(BODY)) if i == 1 or rng.random() < 0.8]
    inner = [BODY[i] for i in picked]
    for name in ("advert", "form", "script", "comment"):
        if rng.random() < 0.4:
            inner.insert(rng.randint(1, len(inner)), PARTS[name])
    around = rng.sample(sorted(PARTS), rng.randint(2, len(PARTS)))
    cut = rng.randint(0, len(around))
    tag = rng.choice(["article", "main", 'div class="post-content"', 'div id="article-body"'])
    page = f"<html><head><title>t</title></head><body>{''.join(PARTS[x] for x in around[:cut])}<{tag}>{''.join(inner)}</{tag.split()[0]}>{''.join(PARTS[x] for x in around[cut:])}</body></html>"
    if rng.random() < 0.3:
        page = page.replace("</body></html>", "")
    assert text(page) == " ".join(WANT[i] for i in picked)


def test_blocks_carry_words_and_link_density():
    a, b, c = blocks_of("<p>one two</p><p>three <a href=x>four five</a></p>six")
    assert (a.words, a.density, b.words, b.density, c.text) == (2, 0, 3, 2 / 3, "six")
    assert html_text.features([a, b, c])[1].tolist()[:6] == [3, 2 / 3, 2, 0, 1, 0]


def test_tree_fits_its_table_and_needs_the_neighbours_only_at_need():
    from quadweave.llm.html_examples import PAGES

    x, y = html_text.labelled_blocks(PAGES)
    assert len(y) > 80 and 0.2 < y.mean() < 0.8
    tree = default_tree()
    assert sum(html_text.keeps(tree, row) == bool(label) for row, label in zip(x, y)) >= 0.97 * len(y)


def test_pages_of_every_kind(spark):
    pages = [
        (1, "u", None), (2, None, ""), (3, "u", "plain words only, but a good number of them, with no tag around at all"), (4, "u", "<p" * 2_000), (5, "u", "<article>" + "<p>many words here</p>" * 20_000 + "</article>"),
        (6, "u", "<div>" * 3_000 + "deep text with some words to read"), (6, "u", "<article><p>again</p></article>"), (None, "u", "<article><p>no id</p></article>"), (7, "u", "&lt;&#x41;&bogus; <!-- open"), (8, "u", "</p></div><article>x<p>y</article>"),
    ]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = extract_text(df).collect()
    assert len(got) == len(pages)
    by_id = {r["page_id"]: r for r in got if r["page_id"] != 6}
    assert by_id[1]["text"] == by_id[2]["text"] == "" and by_id[2]["url"] is None and by_id[1]["n_chars"] == 0
    assert by_id[5]["text"] == " ".join(["many words here"] * 20_000) and by_id[5]["n_chars"] == len(by_id[5]["text"])
    assert by_id[None]["text"] == "no id" and by_id[8]["text"] == "x y"
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("head", [
    "<head><title>t</title><meta charset=utf-8><body>", "<html><head><script>x()</script><style>p{}</style>", "<head><title>t</title><noscript><link href=x></noscript><body>",
    "<head><noscript><img src=x><body>", "<body><select><option>One<option>Two", "<body><svg><g><path>", "<head><body><header class=head><a href=/>Top</a></header>",
])
def test_pages_whose_silent_elements_are_left_open(head):
    article = "<article><h1>A title</h1><p>One paragraph that is long enough to be text of it.</p></article>"
    assert text(head + article) == "A title One paragraph that is long enough to be text of it."


def test_silent_elements_that_are_closed_stay_silent():
    article = "<article><p>One paragraph that is long enough to be text of it.</p></article>"
    for part in ("<head><title>no</title></head>", "<select><optgroup><option>no</option></optgroup></select>", "<svg><foreignObject><div>no</div></foreignObject></svg>", "<noscript><p>no</p></noscript>", "<video><p>no</p></video>"):
        assert text(part + article) == "One paragraph that is long enough to be text of it."
    assert [b.text for b in blocks_of("<head><title>t</title> Plain words")] == ["Plain words"]


@pytest.mark.parametrize("wrapper", [
    '<form id="aspnetForm">', "<form><fieldset>", '<main><form>', '<div id="main"><form>', '<div class="has-comments">', '<div class="page comments-open">', '<div id="no-ads">',
    '<div class="related-topic">', '<div class="page ads">', '<form class="has-comments"><div class="related-topic">', '<div class="content ads">',
])
@pytest.mark.parametrize("tag", ["article", "main", 'div role="main"', 'article class="no-comments"'])
def test_articles_inside_wrappers_come_out(wrapper, tag):
    inner = f"<{tag}><h1>A title</h1><p>One paragraph that is long enough to be text of it.</p><p>Of.</p><div class=ad>Buy one now and get a second one for half.</div><form><p>Sign up to our letter now and read more of it.</p></form><p>Last words of the text.</p></{tag.split()[0]}>"
    closing = "".join(f"</{t[1:].split()[0].rstrip('>')}>" for t in reversed(wrapper.replace("><", ">|<").split("|")))
    comments = '<section id="comments"><article><p>I do not agree with a single word of this, sorry to say.</p></article></section>'
    for page in (inner, PARTS["menu"] + inner + comments + PARTS["footer"]):
        assert text(f"<body>{wrapper}{page}{closing}</body>") == "A title One paragraph that is long enough to be text of it. Of. Last words of the text."


def test_a_form_around_a_page_without_article_tags():
    assert text('<body><form><div id="content"><h1>A title</h1><p>One paragraph that is long enough to be text.</p></div></form></body>') == "A title One paragraph that is long enough to be text."


def test_several_articles_in_one_wrapper():
    articles = "".join(f"<article><p>Paragraph {n} is long enough to be text of an article.</p></article>" for n in ("one", "two"))
    assert text(f"<body><div class='page ads'>{articles}</div></body>") == "Paragraph one is long enough to be text of an article. Paragraph two is long enough to be text of an article."


LONG = "The council met on Tuesday to hear about the new bridge and decided after a long debate that the work should start in spring, before the river rises again."
MID = "Nobody in the room spoke against it, not even the two members who had done so last year."
MENU = "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li><li><a href=z>Sport</a></li></ul>"
READ = {
    "a notice left open": (f'<body><p class="notice">We use things<div id="content"><p>{LONG}<p>{MID}<div>{LONG}</div></div></body>', f"{LONG} {MID} {LONG}"),
    "an advert left open in the text": (f'<body><article><p>{LONG}<p class="ad">Buy flour<div>{MID}</div><p class="ad">Buy<ul><li>one<li>two</ul></article>', f"{LONG} {MID} one two"),
    "a cell left open": (f'<article><table><tr><td class="ad">x<td>{MID}<tr><td>{LONG}</table></article>', f"{MID} {LONG}"),
    "comments as articles": (f'<body>{MENU}<div id="content"><h1>T</h1><p>{LONG}</p></div><section id="comments"><article><p>I like {MID}</p></article><article>No.</article></section></body>', f"T {LONG}"),
    "comments by a longer name": (f'<body><div class="post"><p>{LONG}</p></div><div class="user-comments"><article>{MID}</article></div></body>', LONG),
    "a wrapper that has comments": (f'<body><div class="has-comments comments-open"><article><p>{LONG}</p></article></div></body>', LONG),
    "an advert inside a line": (f'<article><p>In <span class="ad">Buy <span>now</span></span> the end.</p><p>{LONG}</p></article>', f"In the end. {LONG}"),
    "neutral names": (f"<body>{MENU}<div><h1>A bridge</h1><p>{LONG}</p><p>Good.</p><p>{MID}</p></div><p>Share this</p>{MENU}</body>", f"A bridge {LONG} Good. {MID}"),
    "a line at the end": (f"<body><div><p>{MID}</p><p>{LONG}</p></div><p>Share this</p></body>", f"{MID} {LONG}"),
    "a link between paragraphs": (f"<body>{MENU}<div><p>{LONG}</p><p><a href=x>The plan of 1911</a></p><p>{LONG} {MID}</p></div></body>", f"{LONG} The plan of 1911 {LONG} {MID}"),
    "little text": ("<h1>x</h1><p>Short one.</p><p>Short two.</p>", "x Short one. Short two."),
}


@pytest.mark.parametrize("name", READ)
def test_pages_read(name):
    html, text = READ[name]
    assert main_text(html, default_tree()) == text


def test_the_tree_asks_for_words_and_neighbours():
    asked = set()

    def walk(tree):
        if not isinstance(tree, float):
            asked.add(html_text.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(default_tree())
    assert {"words", "density"} <= asked and asked & {"words_before", "words_after", "density_before", "density_after"}
