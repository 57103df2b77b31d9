"""Small labelled table for the block classifier: pages whose elements say what is text of the article.

``data-keep="1"`` marks elements of the article, ``data-keep="0"`` everything else; blocks take the
mark of the nearest element around them. The texts are invented.
"""

_LONG = (
    "The old mill by the river was rebuilt twice in a century, once after a flood and once after a fire, and each time "
    "the village paid for the new wheel with a harvest of its own, as the parish books still show to anyone who asks."
)
_MID = "Visitors who come in spring find the gate open and the miller glad to talk about stones and grain."
_SHORT = "Nobody asked."
_LIST = "flour, bran, two kinds of meal"
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "About us", "Contact", "Archive"))
_NAV = f'<nav data-keep="0"><ul>{_LINKS}</ul></nav>'
_FOOT = '<footer data-keep="0"><p>&copy; 2020 River Press</p><p>All rights reserved by the publisher and its partners.</p></footer>'

PAGES = [
    # An article between menu and footer, with very short paragraphs.
    f"""<html><head><title>Mill</title></head><body>{_NAV}<article data-keep="1"><h1>The mill</h1><p>{_LONG}</p><p>{_SHORT}</p>
    <p>{_MID}</p><p>Of.</p><h2>Later</h2><p>{_LONG}</p><p>See <a href="/x">the parish books</a>.</p></article>{_FOOT}</body></html>""",
    # The same, adverts as plain blocks of text, paragraphs left open.
    f"""<body>{_NAV}<div class="ad" data-keep="0">Buy the best flour in town, now with free delivery to your door.</div>
    <article data-keep="1"><h1>Bread</h1><p><b>{_MID}<br><p>{_SHORT}<p>{_LONG}<p>Yes.</article>{_FOOT}""",
    # Boxes of named elements without any semantic tag.
    f"""<body><div id="header" data-keep="0"><h1>River Press</h1><p>News from the valley since 1911</p></div><div class="menu" data-keep="0"><ul>{_LINKS}</ul></div>
    <div id="content" data-keep="1"><h2>A wheel returns</h2><p>{_LONG}</p><ul><li>{_LIST}</li><li>{_SHORT}</li></ul><p>{_MID}</p></div>
    <div class="sidebar" data-keep="0"><h3>Most read</h3><ul>{_LINKS}</ul><p>{_MID}</p></div><div id="footer" data-keep="0"><p>{_MID}</p></div></body>""",
    # Comments of readers, a form and a notice around and after the article.
    f"""<body><div class="cookie-notice" data-keep="0"><p>We use cookies to make this site work and to learn how it is read by you.</p><button>OK</button></div>{_NAV}
    <main><article data-keep="1"><header><h1>Harvest</h1></header><p>{_LONG}</p><p>{_MID}</p><blockquote>{_SHORT}</blockquote><p>{_LONG}</p></article>
    <section class="comments" data-keep="0"><h3>2 comments</h3><div class="comment"><p>{_LONG}</p></div><div class="comment"><p>{_SHORT}</p></div>
    <form><label>Your name</label><input name="n"><textarea></textarea></form></section></main>{_FOOT}</body>""",
    # An article with an advert, a box of related links and a form inside it.
    f"""<body>{_NAV}<article data-keep="1"><h1>Stones</h1><p>{_LONG}</p><div class="advert" data-keep="0"><p>{_MID}</p></div><p>{_SHORT}</p>
    <aside data-keep="0"><h4>Related</h4><ul>{_LINKS}</ul></aside><p>{_LONG}</p><form data-keep="0"><p>Subscribe to our letter and never miss a harvest again.</p></form><p>{_MID}</p></article>{_FOOT}</body>""",
    # No named element at all: lengths and links must decide.
    f"""<body><p data-keep="0"><a href="/">Home</a> | <a href="/a">Archive</a> | <a href="/c">Contact</a></p><h1 data-keep="1">The weir</h1><p data-keep="1">{_LONG}</p><p data-keep="1">{_MID}</p>
    <p data-keep="1">{_SHORT}</p><p data-keep="1">{_LONG}</p><p data-keep="0"><a href="/p">Previous page</a> <a href="/n">Next page</a></p></body>""",
    f"""<body><div><table><tr><td data-keep="0"><a href="/1">One</a></td><td data-keep="0"><a href="/2">Two things</a></td></tr></table></div><div><p data-keep="1">{_LONG}</p><p data-keep="1">{_LONG}</p>
    <p data-keep="1">In <a href="/r">the register of 1811</a> {_MID}</p></div><div data-keep="0"><a href="/t">Terms of use</a> <a href="/i">Imprint</a></div></body>""",
    # A list of links inside the article is text of the article.
    f"""<body>{_NAV}<main data-keep="1"><h1>Sources</h1><p>{_MID}</p><ul><li><a href="/s1">Parish book of Saint Anne</a></li><li><a href="/s2">Tax rolls, second volume</a></li></ul><p>{_LONG}</p></main>{_FOOT}</body>""",
    # Page header, search box, notice and pager.
    f"""<body><header data-keep="0"><a href="/">River Press</a><p>{_MID}</p></header><div role="search" data-keep="0"><p>Search</p></div><div class="alert" data-keep="0"><p>{_MID}</p></div>
    <div class="post" data-keep="1"><h1>Eels</h1><p>{_SHORT}</p><p>{_LONG}</p><pre>one two three</pre></div><div class="pagination" data-keep="0"><a href="/2">2</a> <a href="/3">3</a></div><div class="newsletter" data-keep="0"><p>{_MID}</p></div></body>""",
    # One form around the whole page, and wrappers whose names merely hold a listed word.
    f"""<body><form id="aspnetForm">{_NAV}<main><article data-keep="1"><h1>Sluices</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MID}</p></article></main>{_FOOT}</form></body>""",
    f"""<body class="no-ads"><div class="has-comments related-topic">{_NAV}<article data-keep="1"><h1>Locks</h1><p>{_SHORT}</p><p>{_LONG}</p></article>
    <div class="comments" data-keep="0"><article><p>{_LONG}</p></article><article><p>{_SHORT}</p></article></div></div>{_FOOT}</body>""",
]

# Pages in which no name or tag tells what is text: the same kinds of blocks around texts of other lengths. Short
# lines without links and lists of links stand around the text; short paragraphs and single links stand inside it.
_WORDS = (_LONG + " " + _MID).replace(",", "").split()


def _run(n, at=0):
    return " ".join((_WORDS * 4)[at % 40 : at % 40 + n])


def _links(n, each=1):
    return "".join(f'<li><a href="/{i}">{_run(each, 7 * i)}</a></li>' for i in range(n))


def _text(lengths, at):
    return "".join(f"<p>{_run(n, at + i)}</p>" for i, n in enumerate(lengths))


_TEXTS = [(45, 4, 60), (38, 52, 7, 41), (70, 2, 33, 90), (25, 6, 30), (55, 3, 48, 1, 64), (31, 9, 47)]
for _i, _lengths in enumerate(_TEXTS):
    _whole = f"""<h1>{_run(2 + _i, _i)}</h1>{_text(_lengths, 5 * _i)}<p><a href="/s">{_run(3 + _i, _i)}</a></p>{_text((22 + 9 * _i, 3, 75 - 11 * _i), _i)}"""
    PAGES += [
        # A line of the site above a menu; a short line and links after the text.
        f"""<body><div data-keep="0">{_run(2 + _i)}</div><ul data-keep="0">{_links(3 + _i, 1 + _i % 3)}</ul><div data-keep="1">{_whole}</div>
        <div data-keep="0">{_run(1 + _i)}</div><ul data-keep="0">{_links(2 + _i)}</ul></body>""",
        # A short line alone closes the page, or stands between lists of links.
        f"""<body><ul data-keep="0">{_links(4 + _i, 2)}</ul><div data-keep="1">{_whole}</div><p data-keep="0">{_run(1 + _i)}</p></body>""",
        f"""<body><div data-keep="1">{_whole}</div><ul data-keep="0">{_links(3, 1 + _i)}</ul><p data-keep="0">{_run(1 + _i)}</p><ul data-keep="0">{_links(2 + _i, 2)}</ul></body>""",
        # The last paragraph is of the text when it is longer than such lines.
        f"""<body><div data-keep="1">{_whole}<p>{_run(12 + 3 * _i)}</p></div></body>""",
        f"""<body><ul data-keep="0">{_links(3)}</ul><div data-keep="1"><p>{_run(12 + 3 * _i)}</p>{_text((40, 12 + _i), 1)}</div><ul data-keep="0">{_links(3)}</ul></body>""",
        # Pages that are nothing but text, however short.
        f"""<body><p data-keep="1">{_run((1, 3, 8, 20, 40, 80)[_i])}</p></body>""",
        f"""<body data-keep="1"><h1>{_run(1 + _i)}</h1>{_text((2 + _i, 1 + _i, 3), 1)}</body>""",
        f"""<body data-keep="1"><h1>{_run(3 + _i)}</h1>{_text((50 + _i, 12 + _i), 1)}</body>""",
        f"""<body data-keep="1"><table><tr><td>{_run(1 + _i % 3)}<td>{_run(1)}<tr><td>{_run(2)}<td>{_run(1 + _i % 2)}</table></body>""",
    ]
