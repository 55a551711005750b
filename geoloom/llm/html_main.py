"""Main text of HTML pages by line-block distribution.

A page becomes lines, one per block. Markup that can't hold an article (scripts, styles, forms, menus, page
headers and footers, sidebars, notices, adverts, comments) leaves blank lines, and so do the borders of article and main elements.
Lengths of text outside links are summed over a sliding window of lines. A surge point is where the sums rise from nothing to a share of
the page's largest sum, a dive point is where they fall back to nothing, and the text between them, with the lines that led up to
the surge, is kept.

Markup is evidence, in two ways. Sums inside an article or main element count more when the largest is sought, and beside a largest one
inside such an element only others inside count as surges. And the element that holds the largest surge (the article or main element around it, else the
container with most of its text; at the top of the page the parts that stand there themselves) is looked at once more without the
blank lines that dropped markup left in it, and without a least sum: so short parts of an article stay. Headings of links that lead to a
kept line stay too.

The whole page is read. Null or empty html gives an empty text, and so does a page of links alone. Broken markup is read as far as it
goes: an open tag at the end of a page is dropped. An element whose end tag is missing ends where its parent does, or, where HTML lets
the end tag be omitted, at a sibling; without such an end it isn't dropped. Only scripts, styles, text areas and comments run to the
end. Repeated rows are kept, an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import map_batches

#: Lines under the sliding window, and blank lines that dropped markup leaves.
WINDOW = 3
#: Share of the page's largest windowed sum at which a sum is a surge.
SURGE = 0.2
#: How much more text counts inside an article or main element.
EVIDENCE = 5

#: Fixed lists of HTML element names.
_RAW = "script style textarea"
_EMBEDDED = frozenset("noscript template iframe object canvas select head title desc metadata annotation annotation-xml".split())
_DROPPED = frozenset("nav footer aside form button dialog menu label fieldset".split())
_BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside dialog menu".split()
)
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements whose end tag may be missing.
_OPTIONAL = frozenset("p li dt dd tr td th thead tbody tfoot caption option optgroup head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Lines and parts of an article; their container is further out.
_INNER = _HEADINGS | frozenset(
    "p pre li dt dd ul ol dl blockquote address center figure figcaption section summary details legend table tbody thead tfoot tr td th hr html body".split()
)
_ROWS = ("tr", "td", "th")
#: What a start tag ends if it is open, inside the innermost of the elements after it.
_CELL = ("table", "td", "th", "caption", "button", "object", "template")
_ENDS = {
    **{b: (("p",), _CELL) for b in _BLOCKS - {"html", "body"}},
    "li": (("p", "li"), ("ul", "ol", "menu", *_CELL)),
    **dict.fromkeys(("dt", "dd"), (("p", "dt", "dd"), ("dl", *_CELL))),
    **dict.fromkeys(("td", "th"), (("td", "th", "caption"), ("table",))),
    "tr": ((*_ROWS, "caption"), ("table",)),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "caption", *_ROWS), ("table",))),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark other content than the article.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|banners?|promos?|promotion|cookies?|consent|notices?|alerts?|"
    r"sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|disqus|respond|replies|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|popup|modal|overlay|toolbar|widgets?|footer|masthead|topbar|pagination|pager|login|signup|search|"
    r"contentinfo|complementary|skip|copyright|gdpr|disclaimer)(?:$|[\s_-])",
    re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Attributes up to the end of a tag. Quotes without a partner are plain signs, and nothing is tried twice, so time is linear.
_REST = r"""(?:[^>"']++|"[^"]*"|'[^']*'|["'])*+"""
_NOISE = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({'|'.join(_RAW.split())})(?=[\s/>]){_REST}(?:>|\Z).*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)", re.I | re.S
)
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_REST})(?:>|\Z)|<[!?][^>]*+(?:>|\Z)")


#: A letter or digit, as itself or as a character reference.
_WORDS = re.compile(r"[^\W_]")
#: Names that only say what a wrapper has or lacks.
_LAYOUT = re.compile(r"(?:no|has|with|without|hide|show)[-_]", re.I)


def _is_marked(attributes: str) -> bool:
    names = (n for a, b, c in _NAMED.findall(attributes) for n in (a or b or c).split())
    return any(_MARKED.search(n) and not _LAYOUT.match(n) for n in names)


def _stands_alone(tag: re.Match) -> bool:
    # a slash at the end of a value without quotes belongs to the value
    return tag[2].lower() in _VOID or (tag[3].endswith("/") and (tag[3] == "/" or tag[3][-2] in " \t\n\r\f\"'"))


def ends(page: str, tags: list[re.Match]) -> tuple[list[tuple[int, int] | None], list[int], list[int]]:
    """How the elements of a page lie.

    (number of the next tag, place in the page) after the element of each start tag, None where nothing ends it; the start tag of the
    element around each start tag, and around the text before each tag and after the last one, -1 at the top. Tags are those of the page in order. Elements with optional end tags end with the page at the latest.
    """
    out: list[tuple[int, int] | None] = [None] * len(tags)
    parent, home = [-1] * len(tags), [-1] * (len(tags) + 1)
    opened: list[int] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name, in ``opened``
    blocks: list[int] = []
    name_of = [(t[2] or "").lower() for t in tags]
    marks = [k for k, n in enumerate(name_of) if n in ("title", "head", "body")]
    titled = {a for a, b in zip(marks, marks[1:]) if name_of[a] == name_of[b] == "title" and not tags[a][1] and tags[b][1]}

    def last(*names: str) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def cut(to: int, k: int, at: int) -> None:
        while len(opened) > to:
            o = opened.pop()
            out[o] = k, at
            places[name_of[o]].pop()
            if blocks and blocks[-1] == len(opened):
                blocks.pop()

    at = 0
    for k, tag in enumerate(tags):
        name, close, begin = name_of[k], bool(tag[1]), tag.start()
        top = name_of[opened[-1]] if opened else ""
        if top == "head" and page[at:begin].strip():
            cut(len(opened) - 1, k, at)
            top = ""
        at, home[k] = tag.end(), opened[-1] if opened else -1
        if not name:
            continue
        if top == "title" and name != "title":
            # its text has no tags; without an end tag it ends with the head
            if opened[-1] in titled or not (name in ("head", "body") or name in _BLOCKS):
                continue
            cut(len(opened) - 1, k, begin)
            top = name_of[opened[-1]] if opened else ""
        if close:
            own = last(name)
            if own < 0 or name in ("html", "body"):
                continue
            if name in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"):
                wall = last("table")
            elif name in _BLOCKS or name in _EMBEDDED or name == "button":
                wall = last("ul", "ol", *_CELL) if name == "li" else last(*_CELL)
            else:
                wall = blocks[-1] if blocks else -1
            if own >= wall:
                cut(own + 1, k, begin)
                cut(own, k + 1, at)
            continue
        if name == "body" or (top == "head" and name not in _IN_HEAD):
            head = last("head")
            if head >= 0:
                cut(head, k, begin)
        if name in _ENDS:
            ended, within = _ENDS[name]
            wall = last(*within)
            cut(min((p for n in ended if (p := last(n)) > wall), default=len(opened)), k, begin)
        if _stands_alone(tag) or name in ("html", "body"):
            continue
        places.setdefault(name, []).append(len(opened))
        if name in _BLOCKS or name == "button":
            blocks.append(len(opened))
        parent[k] = opened[-1] if opened else -1
        opened.append(k)
    if opened and name_of[opened[-1]] == "head" and page[at:].strip():
        cut(len(opened) - 1, len(tags), at)
    home[-1] = opened[-1] if opened else -1
    for o in opened:
        if name_of[o] in _OPTIONAL:
            out[o] = len(tags), len(page)
    return out, parent, home


def lines(page: str) -> tuple[list[tuple[str, int, int, int]], list[int], list[str]]:
    """Lines, and the parent and name of each element.

    A line is (text, characters of it outside links, outermost article or main element around it or -1, element around it) of each block;
    dropped markup and the borders of these elements give blank lines. Signs between links count as none.
    """
    out: list[tuple[str, int, int, int]] = []
    text: list[str] = []
    linked = link = 0
    worded = False
    articles: list[int] = []
    around = None

    def end() -> None:
        nonlocal linked, around, worded
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            out.append((line, max(0, len(line) - linked) if worded else 0, articles[0] if articles else -1, -1 if around is None else around))
        text.clear()
        linked, around, worded = 0, None, False

    gap = [("", 0, -1, -1)] * WINDOW
    page, at = _NOISE.sub(" ", page), 0
    tags = list(_TAG.finditer(page))
    (ended, parent, home), until = ends(page, tags), 0
    for k, m in enumerate(tags):
        if k < until:
            continue
        if m.start() > at:
            text.append(page[at : m.start()])
            if around is None and not text[-1].isspace():
                around = home[k]
            if link:
                linked += m.start() - at
            elif not worded:
                worded = _WORDS.search(text[-1]) is not None
        at = m.end()
        if m[2] is None:
            continue
        close, name = bool(m[1]), m[2].lower()
        if close:
            link = max(0, link - (name == "a"))
            if name in _BLOCKS:
                end()
            if articles and name in ("article", "main"):
                articles.pop()
                out += [] if articles else gap
            continue
        if name in _BLOCKS:
            end()
        if name == "br":
            text.append(" ")
        link += name == "a"
        if _stands_alone(m) or name in ("html", "body"):
            continue
        if name in ("article", "main"):
            if name == "main" or not _is_marked(m[3]):
                articles.append(k)
                out += gap if len(articles) == 1 else []
                continue
        embedded = name in _EMBEDDED
        if ended[k] is not None and (embedded or name in _DROPPED or (name == "header" and not articles) or _is_marked(m[3])):
            if embedded:
                text.append(" ")
            else:
                end()
                out += gap
                link -= name == "a"
            until, at = ended[k]
    text.append(page[at:])
    worded = worded or (not link and _WORDS.search(text[-1]) is not None)
    if around is None:
        around = home[-1]
    end()
    return out, parent, [(m[2] or "").lower() for m in tags]


def in_container(found: list[tuple[str, int, int, int]], largest: tuple[int, int], parent: list[int], name: list[str]) -> list[int]:
    """Numbers of the lines in the innermost container with more than half of the largest region's unlinked text."""
    texts = [k for k, line in enumerate(found) if line[0]]
    inner = lambda e: name[e] in _INNER or name[e] not in _BLOCKS
    # parents come before their children, so one pass up or down is enough
    outer, held, weight = [-1] * len(name), [0] * (len(name) + 1), [0] * (len(name) + 1)
    for e, up in enumerate(parent):
        outer[e] = (outer[up] if up >= 0 else -1) if inner(e) else e
    own = {k: outer[found[k][3]] if found[k][3] >= 0 else -1 for k in texts}
    for k in texts:
        held[own[k]] += 1
        weight[own[k]] += found[k][1] if largest[0] <= k < largest[1] else 0
    half = sum(line[1] for line in found[slice(*largest)]) / 2
    direct = weight[-1] > half
    for e in range(len(name) - 1, -1, -1):
        if parent[e] >= 0:
            held[parent[e]] += held[e]
            weight[parent[e]] += weight[e]
    # an element with one line is a line
    best = -1 if direct else max((e for e in range(len(name)) if not inner(e) and held[e] > 1 and weight[e] > half), default=-1)
    if best < 0:
        alone = lambda e: e < 0 or (not direct and held[e] == 1 and (parent[e] < 0 or outer[parent[e]] < 0))
        return [k for k in texts if alone(own[k])]
    inside = [False] * len(name)
    for e in range(best, len(name)):
        inside[e] = e == best or (parent[e] >= 0 and inside[parent[e]])
    return [k for k in texts if own[k] >= 0 and inside[own[k]]]


def regions(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line, end, largest sum) of the lines between each rise of the windowed sums from nothing and the dive that follows."""
    out, begin, total, most = [], None, 0, 0
    for k, n in enumerate(lengths):
        total += n - (lengths[k - window] if k >= window else 0)
        if total and begin is None:
            begin, most = k, 0
        most = max(most, total)
        if not total and begin is not None:
            out.append((begin, k - window + 1, most))
            begin = None
    if begin is not None:
        out.append((begin, len(lengths), most))
    return out


def main_text(page: str | None) -> str:
    """The kept blocks in page order, joined by a newline."""
    found, parent, name = lines(page or "")
    every = regions([line[1] for line in found])
    if not every:
        return ""
    article = lambda r: max(line[2] for line in found[r[0] : r[1]])
    best = max(every, key=lambda r: r[2] * (EVIDENCE if article(r) >= 0 else 1))
    marked = article(best) >= 0
    kept = {k for r in every if r[2] >= SURGE * best[2] and (article(r) >= 0 or not marked) for k in range(*r[:2])}
    near = [k for k, line in enumerate(found) if line[2] == article(best)] if marked else in_container(found, best[:2], parent, name)
    kept.update(near[k] for r in regions([found[k][1] for k in near]) for k in range(*r[:2]))

    headed = []
    for n, up in zip(name, parent):
        headed.append(n in _HEADINGS or (n not in _BLOCKS and up >= 0 and headed[up]))

    def heads(k: int) -> bool:
        return found[k][3] >= 0 and headed[found[k][3]]

    for own in (near, range(len(found))):
        for k, after in zip(reversed(own[:-1]), reversed(own[1:])):
            if after in kept and found[k][0] and k not in kept and heads(k):
                kept.add(k)
    return "\n".join(found[k][0] for k in sorted(kept) if found[k][0])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id long, url string, text string, n_chars long): a row per row of ``pages``, without a shuffle."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t) for t in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, one, "page_id long, url string, text string, n_chars long")
