import pytest

from ledgerloom.llm.html_extract import extract, main_text

S1 = "The first sentence, of some length, tells what the page is about and goes on."
S2 = "A second paragraph follows, again with commas, and enough letters to count."
S3 = "The third, and last, closes the article with a few more words, as they do."
PS = f"<p>{S1}</p><p>{S2}</p><p>{S3}</p>"
ALL = f"{S1} {S2} {S3}"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("   \n", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        (f"<body><nav><ul><li><a href=/>Home, sweet, home, and more of it</a></ul></nav><article><h1>Title</h1>{PS}</article><footer>&copy; someone, somewhere</footer>", f"Title {ALL}"),
        (f"<div class='ad'>Buy, buy, buy this great thing today, it is cheap.</div><div id=main><h1>T &amp; U</h1>{PS}</div><div class=sidebar>{PS}</div>", f"T & U {ALL}"),
        (f"<article><p><b>{S1}<br><p>{S2}</p><script>var t='</p>, , ,';</script><style>p,b{{}}</style><p>{S3}</article>", ALL),
        (f"<main><section>{PS}</section><section>{PS}</section><section>{PS}</section></main>", f"{ALL} {ALL} {ALL}"),
        (f"<article>{PS}<section id='comments'><article class=comment><p>{S1}</p></article></section></article>", ALL),
        (f"<article>{PS}<aside><p>{S1}</p></aside><form><label>Name, please</label><input></form></article>", ALL),
        (f"<article><header><h1>Head</h1></header>{PS}</article><header><p>{S1}</p></header>", f"Head {ALL}"),
        (f"<body><div class='cookie-notice'><p>{S1}</p></div><div class=content>{PS}<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></div>", ALL),
        (f"<p>{S1}</p><p>{S2} <a href='x'>link</a></p>", f"{S1} {S2} link"),
        ("just text, without any markup at all, but long enough", "just text, without any markup at all, but long enough"),
        ("short", "short"),
        (f"<article><p>a&nbsp;&lt;b&gt;  &#233;\n&amp;amp;<!-- no, no --> c</p>{PS}</article>", f"a <b> é &amp; c {ALL}"),
        (f"<article><p>x<i>y</i>z<br/>w 1 < 2</p>{PS}<table><tr><td>c1<td>c2</table></article>", f"xyz w 1 < 2 {ALL} c1 c2"),
        (f"<article class='post has-sidebar'>{PS}<div hidden>{S1}</div><p style='display: none'>{S1}</p></article>", ALL),
        (f"<article>{PS}<p title='a>b' class=x>End.</p><p title=\"open>Gone", f"{ALL} End. Gone"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "sibling, text",
    [
        ("<ul><li>one</li><li>two</li></ul>", "one two"),
        ("<p>Short, no stop</p>", "Short, no stop"),
        ("<div>a</div><h4>Head</h4>", "a Head"),
        ("<table><tr><td>1</td><td>2</td></tr></table>", "1 2"),
        ("<section>Brief.</section>", "Brief."),
        ("<figure><figcaption>A picture</figcaption></figure>", "A picture"),
        ("bare words", "bare words"),
        (f"<div><div>{PS}</div></div>", ALL),
    ],
)
def test_siblings_stay(sibling, text):
    assert main_text(f"<main><div><p>{S1}</p><p>{S2}</p></div>{sibling}</main>") == f"{S1} {S2} {text}"
    assert main_text(f"<body><nav>x</nav><div><div><p>{S1}</p><p>{S2}</p></div>{sibling}</div></body>").startswith(f"{S1} {S2} {text}")


def test_inside_an_article_only_what_is_named_goes():
    assert main_text(f"<article>{PS}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>") == f"{ALL} one two three"
    assert main_text(f"<article>{PS}<p class='verb-form'>I am, you are.</p></article>") == f"{ALL} I am, you are."
    assert main_text(f"<article>{PS}<p class='advert'>Buy, buy.</p><div class='share-buttons'>Share</div></article>") == ALL
    assert main_text(f"<main><article>{PS}</article><article><p>{S1}</p></article><div class='related'>{PS}</div></main>") == f"{ALL} {S1}"


NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News, and more news than anyone can read</a></ul></nav>"
WRAPPERS = [
    "div class='content-area has-sidebar'", "div class='layout with-sidebar'", "div class='social-issues'", "form id=aspnetForm", "form role=form class=page-form",
    "div class='modal'", "div id=overlay", "section class='widgetArea'", "div class='page-header-offset'", "div class='no-comments'", "div class='sharedLayout ad-free'",
    "form id=f><div class='site-menu-layout'", "div class=modal><form", "header",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<div class=content>{}</div>", "<main><section>{}</section></main>", "<table><tr><td>{}</td></tr></table>"])
def test_no_wrapper_hides_the_article(wrapper, inner):
    for comments in ("", f"<div class='comment post'><p>{S1}</p></div>", f"<ol class=commentlist><li class='comment'><p>{S2}</p></li></ol>"):
        page = f"<html><body>{NAV}<{wrapper}>{inner.format(PS)}{comments}</{wrapper.split()[0]}><div class='ad'>Buy, buy, buy this great thing today, it is cheap.</div></body></html>"
        assert main_text(page) == ALL, page


@pytest.mark.parametrize(
    "part, text",
    [
        ("<div class='entry-header'><h1>Head</h1></div>", "Head"),
        ("<div class='header'><h1>Head</h1></div>", "Head"),
        ("<p class='byline'>By one of us</p>", "By one of us"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "so x=1 holds"),
        ("<fieldset><p>Framed</p></fieldset>", "Framed"),
        ("<div class='tags'>red, green</div>", "red, green"),
        ("<div class='entry-meta'>1 May</div>", "1 May"),
    ],
)
def test_parts_of_an_article(part, text):
    assert main_text(f"<article>{part}{PS}</article>") == f"{text} {ALL}"


def test_links_inside_the_content_stay():
    links = "<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul>"
    assert main_text(f"<body>{NAV}<div class=content>{PS}{links}<p>{S1}</p></div></body>") == f"{ALL} one two three {S1}"
    assert main_text(f"<body><div><p>{S1}</p><p>{S2}</p></div><p><a href=x>The one link of this paragraph</a></p></body>") == f"{S1} {S2} The one link of this paragraph"
    assert main_text(f"<body>{NAV}<div>{PS}<ul><li><a href=1>{S1}</a><li><a href=2>{S2}</a><li><a href=3>{S3}</a></ul></div></body>") == f"{ALL} {ALL}"
    assert main_text(f"<body><div class=menu-top>{links}</div><div>{links}</div><div class=content>{PS}{links}</div></body>") == ALL


def test_a_short_article_is_not_replaced():
    ad = "<div class='ad'>Buy, buy, buy this great thing today, it is cheap.</div>"
    assert main_text(f"<body>{ad}<article><h1>Brief.</h1><p>Yes.</p></article>") == "Brief. Yes."
    assert main_text(f"<body>{ad}<main><h1>Head</h1><form>{PS}</form></main>") == f"Head {ALL}"
    assert main_text(f"<body><form>{ad}<p>Yes.</p></form></body>") != ""


def test_comments_never_stand_in_for_the_article():
    many = "".join(f"<div class='comment entry'><p>{S2}</p></div>" for _ in range(30))
    assert main_text(f"<body><div><p>{S1}</p></div><div id=comments>{many}</div></body>") == S1
    assert main_text(f"<body><div><p>{S1}</p></div>{many}</body>") == S1
    assert main_text(f"<body><article><p>{S1}</p></article><form class=comment-form><p>{S2}</p><textarea></textarea></form></body>") == S1


def test_many_nested_or_stray_tags_take_linear_time():
    import time

    for page in ("<div>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<li><div>" + "<b>" * 100_000 + "</li>" * 100_000, "<header>" * 100_000, "</p>" * 100_000, "<td>" * 100_000):
        began = time.perf_counter()
        main_text(page + PS)
        assert time.perf_counter() - began < 4, page[:20]


def test_depth_and_length():
    deep = "<div>" * 20_000 + PS + "</div>" * 20_000
    assert main_text(deep) == ALL
    many = "<article>" + f"<p>{S1}</p>" * 5000 + "</article>"
    assert main_text(many) == " ".join([S1] * 5000)
    assert main_text("<p " * 20_000).strip() == ""


def test_rows(spark):
    rows = [(1, "u", f"<article>{PS}</article>", "x"), (1, "u", f"<article>{PS}</article>", "x"), (None, None, None, None), (3, "v", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", ALL, len(ALL))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_pages_table(spark):
    """The tables' pages hold their article in one element; its text is what is between its tags."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", inner).replace("<", " <").replace("&lt;", "\0")).split())
        want = " ".join(re.sub(r"<[^>]*>", " ", want).replace("\0", "<").split())
        assert main_text(r.html) == want
