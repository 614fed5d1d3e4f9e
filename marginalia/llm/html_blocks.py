"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Each line weighs the characters of its text that are neither links
nor inside an element that never holds an article (scripts, menus, forms, notices and the like). Weights are summed over
sliding windows of lines; where the sums rise from nothing is a surge point, where they fall back to nothing a dive point.
On a page that marks its article, only lines inside it weigh, and the text between the points is kept.

On any other page a change of container is a gap of empty lines, as the tags between leave it, and a stretch between surge
and dive is kept where a window in it reaches half of the sum that the window of the page's middle character has.
A stretch inside the core, the container that holds more than half of the page's text with its first headline, needs no such
sum, so a short last section stays, and lines outside weigh a quarter. A container that is the whole page is no core, unless
its text stands directly in it.

Lines are only read, never reordered, capped or cut. The work is inside the row, from the whole html: no shuffle.

Defined results: null, empty and text-free pages give an empty text; unclosed elements end with their parent; comments,
doctypes and unknown tags are dropped; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from marginalia.llm.batches import over_rows

#: Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe svg math object select option button".split())
NEVER = frozenset("nav footer aside form dialog menu head".split()) | RAW
ARTICLE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr input").split())
#: Words in class, id or role that mark a container as no part of the article.
CHROME = re.compile(r"(?<![^\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|"
                    r"side-bar|footer|masthead|site-header|page-header|cookies?|consent|gdpr|notice|popup|modal|newsletter|"
                    r"subscribe|comments?|commentlist|disqus|respond|reply|replies|related|recommended|share|sharing|social|"
                    r"toolbar|pagination|pager|widget|complementary|contentinfo|search)(?![^\s_-])", re.I)
#: Those of them that name a part of a layout, which wrappers of a whole page are named after too, and words before them
#: that tell of a state.
LAYOUT = frozenset("nav navbar navigation menu sidebar side-bar footer toolbar widget search".split())
STATE = re.compile(r"(?:^|[_-])(?:has|no|with|without)[_-]", re.I)
REPLIES = re.compile(r"comments?|commentlist|disqus|respond|reply|replies", re.I)
#: Elements that a start tag of the same group closes when it is still open.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
HEAD = frozenset("title meta link style script noscript base template".split())
HEADLINE = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Lines in a window, and the part of the middle character's sum that a stretch outside the core must reach.
WIDTH, SHARE = 3, 0.5
#: Lines outside the core weigh this much less.
OUTSIDE = 4
_PARAGRAPH, _NOTHING = frozenset("p".split()), frozenset()

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>?)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    weight: int
    article: bool
    chrome: bool
    gap: bool = False  # another container begins here
    core: bool = False  # inside the container of most text


class _Open(NamedTuple):
    tag: str
    chrome: bool  # for sure, by tag, role or style
    article: bool
    link: bool
    mark: int = -1  # the innermost mark by a class or id
    told: int = -1  # the innermost <article>
    box: int = 0  # the innermost element that is not inline


class _Mark(NamedTuple):
    above: int
    layout: bool  # only by words of the layout
    whole: bool  # by a class or id that is one such word
    replies: bool


def _marked(values: list[str], above: int) -> _Mark | None:
    """The mark that classes and ids give; those that tell of a state, like has-sidebar, give none."""
    found = [(m[0].lower(), m[0] == token) for value in values for token in value.split() if not STATE.search(token)
             for m in CHROME.finditer(token)]
    if not found:
        return None
    return _Mark(above, all(word in LAYOUT for word, _ in found), any(whole for _, whole in found),
                 any(REPLIES.fullmatch(word) for word, _ in found))


def _lifted(marks: list[_Mark], blocks: list, mains: set[int], articles: list[int]) -> list[bool]:
    """Whether a mark, which only a name gave, is overruled by what its element holds.

    It is where the element holds <main>; the page's longest <article>, of more text than stands clear of all marks, unless the
    name is one of replies; or, named after a part of the layout, most of the page's text - by a name of one word, where
    no text stands clear.
    """
    held, told, clear, total = [0] * len(marks), [0] * len(articles), 0, 0
    for parts in blocks:
        for text, at in parts:
            if at.chrome or at.link:
                continue
            n = len(_SPACE.sub(" ", text).strip())
            total += n
            if at.mark < 0:
                clear += n
            else:
                held[at.mark] += n
            if at.told >= 0:
                told[at.told] += n
    main = [i in mains for i in range(len(marks))]
    longest = max(told, default=0)
    first = [False] * len(marks)
    if longest > clear:
        for i, n in zip(articles, told):
            if n == longest and i >= 0:
                first[i] = True
    for i in range(len(marks) - 1, -1, -1):  # inner marks come after outer ones
        if (above := marks[i].above) >= 0:
            held[above] += held[i]
            main[above] |= main[i]
            first[above] |= first[i]
    most = [m.layout and 2 * n > total and (not m.whole or m.above < 0 and not clear) for m, n in zip(marks, held)]
    return [x or y and not m.replies or z for m, x, y, z in zip(marks, main, first, most)]


def _hides(tag: str, attrs: str, inside_article: bool) -> tuple[bool, list[str]]:
    """Whether an element holds no part of an article, and its names. A header inside an article holds its headline."""
    names: list[str] = []
    if tag in NEVER or tag == "header" and not inside_article:
        return True, names
    if not attrs or tag in ("body", "html", "article", "main"):
        return False, names
    for name, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("class", "id"):
            names.append(value)
        if name == "role" and CHROME.search(value):
            return True, names
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, names
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, names
    return False, names


def _core(boxes: list[tuple[int, str]], own: list[int], first: int) -> list[bool]:
    """Which elements lie inside the container of most text; none where it is the whole page and not flat."""
    held = list(own)
    for i in range(len(boxes) - 1, 0, -1):  # inner elements come after outer ones
        held[boxes[i][0]] += held[i]
    above = set()
    while first > 0:
        above.add(first)
        first = boxes[first][0]
    core = 0
    for i in range(1, len(boxes)):
        if boxes[i][0] == core and 2 * held[i] > held[0] and held[i] > own[i] and (not above or i in above):
            core = i
    flat = own[core] + sum(held[i] for i in range(1, len(boxes)) if boxes[i][0] == core and held[i] == own[i])
    inside = [False] * len(boxes)
    if held[core] < held[0] or 2 * flat >= held[core]:
        inside[core] = True
        for i in range(core + 1, len(boxes)):
            inside[i] = inside[boxes[i][0]]
    return inside


def _apart(boxes: list[tuple[int, str]], depth: list[int], a: int, b: int) -> bool:
    """Whether two lines that follow each other stand in different containers; a headline belongs to what follows."""
    if boxes[a][1] in HEADLINE:
        return False
    steps = 0
    while a != b:
        if depth[a] >= depth[b]:
            a = boxes[a][0]
        else:
            b = boxes[b][0]
        steps += 1
    return steps > 2


def _text(parts: list[tuple[str, _Open]]) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(t for t, _ in parts))).strip()


def lines(page: str | None) -> list[Line]:
    """The lines of a page in order, one per block, with markup stripped and character references decoded."""
    page, spot = page or "", 0
    blocks: list[list[tuple[str, _Open]]] = []
    marks: list[_Mark] = []
    mains: set[int] = set()  # the innermost marks above <main>
    articles: list[int] = []  # the innermost mark above each <article>
    boxes: list[tuple[int, str]] = [(0, "")]  # the element above and the tag of each element that is not inline
    deep = [0]
    stack: list[_Open] = []
    state = _Open("", False, False, False)
    parts: list[tuple[str, _Open]] = []

    def flush() -> None:
        if parts:
            blocks.append(list(parts))
        parts.clear()

    while True:
        token = _TOKEN.search(page, spot)
        text = page[spot:token.start() if token else len(page)]
        if text:
            parts.append((text, state))
        if token is None:
            break
        spot = token.end()
        if not token["tag"]:
            continue
        if not token["close"]:
            if page.find(">", spot) < 0:
                break  # the page was cut off inside a tag
            parts.append((token[0], state))  # a stray less-than sign before a word
            continue
        tag = token["tag"].lower()
        if tag == "br":
            parts.append((" ", state))
            continue
        if tag not in INLINE and tag not in RAW:
            flush()
        if token["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if depth is not None and not (tag in INLINE and any(o.tag not in INLINE for o in stack[depth + 1:])):
                del stack[depth:]
        elif tag not in VOID:
            ends = CLOSES.get(tag, _PARAGRAPH) if tag not in INLINE and tag not in RAW else _NOTHING
            if tag not in HEAD:
                ends = ends | {"head"}
            while (top := next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag not in INLINE), None)) is not None \
                    and stack[top].tag in ends:
                del stack[top:]
            if token["attrs"].endswith("/") and tag in ("svg", "math"):
                continue
            above = stack[-1] if stack else _Open("", False, False, False)
            article = above.article or tag in ARTICLE
            hidden, names = _hides(tag, token["attrs"], above.article)
            mark, told = above.mark, above.told
            if not (above.chrome or hidden):
                if (new := _marked(names, mark)) is not None:
                    mark = len(marks)
                    marks.append(new)
                if tag == "main":
                    mains.add(mark)
                elif tag == "article":
                    told = len(articles)
                    articles.append(mark)
            box = above.box
            if tag not in INLINE and tag not in RAW:
                box = len(boxes)
                boxes.append((above.box, tag))
                deep.append(deep[above.box] + 1)
            stack.append(_Open(tag, above.chrome or hidden, article, above.link or tag == "a", mark, told, box))
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, spot)
                spot = end.end() if end else len(page)
                stack.pop()
        state = stack[-1] if stack else _Open("", False, False, False)
    flush()
    lifted = _lifted(marks, blocks, mains, articles) if marks else []
    away: list[bool] = []  # whether each mark, or one above it, stands
    for mark, free in zip(marks, lifted):
        away.append(not free or mark.above >= 0 and away[mark.above])
    out, at, own, first = [], [], [0] * len(boxes), 0
    for parts in blocks:
        shown = [p for p in parts if not (p[1].chrome or p[1].mark >= 0 and away[p[1].mark])]
        text = _text(shown or parts)
        if text:
            linked = sum(len(_SPACE.sub(" ", t).strip()) for t, o in shown if o.link)
            out.append(Line(text, max(0, len(text) - linked) if shown else 0, parts[0][1].article, not shown))
            box = (shown or parts)[0][1].box
            at.append(box)
            own[box] += out[-1].weight
            if shown and not first and boxes[box][1] == "h1":
                first = box
    inside = _core(boxes, own, first)
    return [line._replace(core=inside[box], gap=i > 0 and _apart(boxes, deep, at[i - 1], box))
            for i, (line, box) in enumerate(zip(out, at))]


def _stretches(weight: list[float], width: int) -> tuple[list[tuple[int, int]], list[float]]:
    """The sums of all windows, and the places between each surge point and its dive point."""
    sums = [sum(weight[i:i + width]) for i in range(len(weight))]
    found, start = [], None
    for i, (block, line) in enumerate(zip(sums, weight)):
        if start is None and line > 0:
            start = i  # surge: the window's own line has text again
        if start is not None and block == 0:
            found.append((start, i))  # dive: nothing in the whole window
            start = None
    if start is not None:
        found.append((start, len(weight)))
    return found, sums


def _threshold(weight: list[float], sums: list[float], share: float) -> float:
    """A share of the sum that the window of the page's middle character has, windows in order of their sums."""
    order = sorted((block, line) for block, line in zip(sums, weight) if line > 0)
    half, seen = sum(line for _, line in order) / 2, 0
    for block, line in order:
        seen += line
        if seen >= half:
            return share * block
    return 0.0


def kept(found: list[Line], width: int = WIDTH, share: float = SHARE) -> list[str]:
    """The lines between each surge point and its dive point whose windows reach the page's threshold."""
    if any(line.article and not line.chrome for line in found):
        # inside a marked article a line of links alone still belongs to it
        weight = [0 if line.chrome or not line.article else len(line.text) for line in found]
        return [found[i].text for a, b in _stretches(weight, width)[0] for i in range(a, b)
                if not found[i].chrome and found[i].article]
    spread: list[Line | None] = []  # with the empty lines of gaps
    for line in found:
        spread += [None] * (width if line.gap else 0) + [line]
    known = any(line.core for line in found)
    weight = [0 if not line else line.weight / OUTSIDE if known and not line.core else line.weight for line in spread]
    stretches, sums = _stretches(weight, width)
    least = _threshold(weight, sums, share)
    return [line.text for a, b in stretches
            if max(sums[a:b]) >= least or any(line.core for line in spread[a:b] if line)
            for line in spread[a:b] if line and not line.chrome]


def main_text(page: str | None) -> str:
    return "\n".join(kept(lines(page)))


def _measure(page: str | None) -> tuple[str, int, int]:
    found = lines(page)
    text = "\n".join(kept(found))
    return text, len(text), len(found)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines) for each page; ``n_lines`` counts the page's lines before extraction."""
    return over_rows(pages, [id_col, url_col], [html_col], "text string, n_chars long, n_lines long", lambda: _measure)
