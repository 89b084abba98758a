"""Main text of web pages by the distribution of text over line blocks (operator 3).

Markup is stripped into lines: a block element begins a line, and each line has its length and the length
of its link text.  Parts that are not text of the page (scripts, styles, menus, headers, footers, sidebars,
forms, notices, adverts, comments; by element, or by whole words of class, id and role) leave empty lines.
The lengths are summed over sliding windows of lines.  A surge is where the sum rises over a threshold, a
dive where it falls back to nothing; what lies between them is a passage.  Where the page marks articles or
a main part, all text of all of them is kept.  Else every passage from the first surge to the last dive is
kept, and also the short ones before and after in the element (not the body) that holds them; link lists
are left out.  A page of which nothing is left is read without the words, then without the elements as well.

Blocks are joined in page order; white space inside a block is one space and character references are
decoded.  Cases: null or empty html, or no text: empty string.  A tag without its end sign is text.  Elements that are never closed end where HTML
implies it (p, li, dd, dt, cells, rows, headings), else with the element around them.  Other columns are
kept; an input column named text or n_chars is replaced.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3            # lines summed
SURGE = 30            # characters in a window at which a passage begins
GAP = WINDOW          # empty lines that a left-out part leaves, so that passages part there
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
tfoot th thead title tr ul""".split())
LEFT_OUT = frozenset("nav footer aside form button select textarea dialog menu fieldset label input iframe object canvas map audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg title iframe object textarea".split())
#: Words of class, id or role that mark a part as no text of the page: all pieces of a word are one of these or say nothing.
MARKS = frozenset("""ad ads advert adverts advertisement advertisements adsense banner banners breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies copyright disqus footer footers gdpr header hidden masthead menu menus modal navbar nav navigation newsletter
notice notices pagination pager popup popups promo promos promotion promotions related recommended replies reply search share sharing
sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription tags teaser teasers toolbar topbar widget
widgets contentinfo complementary""".split())
NEUTRAL = re.compile(r"area|bar|block|bottom|box|button|buttons|container|form|icons|inner|left|link|links|list|main|outer|page|panel|primary|"
                     r"right|secondary|section|site|slot|top|unit|wrap|wrapper|[0-9]+(?:x[0-9]+)?|")
#: These say nothing beside marks of other people's text; the last ones say nothing but beside marks of the page's layout.
NEUTRAL_NAMES = frozenset("""article articles bio blog count entry item items new post posts reader readers thread title user users""".split())
NEUTRAL_PARTS = frozenset("body content inline text".split())
LAYOUT = frozenset("""banner banners footer footers header hidden masthead menu menus modal nav navbar navigation search sidebar sidebars
sidenav skip toolbar topbar""".split())
#: Start tag: the elements that it ends, unless one of the second lies between.
CELLS = ("table", "td", "th", "caption")
LISTS = (*CELLS, *"""article aside blockquote button details dir dl fieldset figure footer form header main menu nav ol section ul""".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ROWS = ("tr", "td", "th", "caption")
ENDS = {"a": (("a",), CELLS), "li": (("li",), LISTS), "dd": (("dd", "dt"), LISTS), "dt": (("dd", "dt"), LISTS),
        "td": (("td", "th", "caption"), ("table",)), "th": (("td", "th", "caption"), ("table",)), "tr": (ROWS, ("table",)),
        **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", *ROWS), ("table",)))}
ENDS_P = BLOCKS - frozenset("html body legend optgroup option title caption tbody td tfoot th thead tr".split())
HOLDERS = frozenset("body center div html section td".split())     # elements that may hold a page's content
OPEN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)""")
TRIES = 8             # unfinished tags up to the same place, before that place is gone to
ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
NOT_SHOWN = re.compile(r"""aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def tokens(page: str):
    """(start, end, CDATA text or None, name or "", whether it closes, attributes) of each tag, and with an empty name of each comment,
    declaration and raw element.  A tag without its end sign is text.  The time is linear in the page's length."""
    at, n, dead, tries = 0, len(page), 0, 0
    while (at := page.find("<", at)) >= 0:
        sign = page[at + 1:at + 2]
        if sign == "!" or sign == "?":
            open_, close = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page[at:at + len(o)].upper() == o), (page[at:at + 2], ">"))
            stop = page.find(close, at + len(open_))
            end = n if stop < 0 else stop + len(close)
            yield at, end, page[at + 9:n if stop < 0 else stop] if len(open_) == 9 else None, "", False, ""
            at = end
            continue
        m = OPEN.match(page, at) if at >= dead or tries < TRIES else None
        if m is None or page[m.end():m.end() + 1] != ">":
            if m is not None:          # no end sign up to where the scan stopped
                tries = tries + 1 if m.end() <= dead else 1
                dead = max(dead, m.end())
            at = dead if at < dead and tries >= TRIES else at + 1
            continue
        name, closing, attributes, end = m[2].lower(), bool(m[1]), m[3], m.end() + 1
        if name in RAW and not closing and not (name == "svg" and attributes.endswith("/")):
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, end)
            yield at, stop.end() if stop else n, None, "", False, ""
            at = stop.end() if stop else n
            continue
        if not (name == "svg" and not closing):
            yield at, end, None, name, closing, attributes
        else:
            yield at, end, None, "", False, ""
        at = end


def lines_of(page: str, filters: int = 2) -> tuple[list[tuple[str, int, int, int]], list[list]]:
    """(text, link characters, number of the article or main part that holds it or 0, element) of each line of the
    page, and [name, element around it, first line, line after the last] of each element.

    ``filters``: 2 leaves parts out by element and by words, 1 by element, 0 none."""
    lines: list[tuple[str, int, int, int]] = []
    elements: list[list] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, int]] = []     # open elements
    where: dict[str, list[int]] = {}      # their places in the stack by name
    skipped = None                        # the place of the left-out element
    parts: list[int] = []                 # open article and main elements
    count = 0
    in_link = False

    def end_line():
        nonlocal linked
        lines.append((" ".join(entities.unescape("".join(text)).split()), linked, parts[-1] if parts else 0, stack[-1][1] if stack else -1))
        text.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        if piece and skipped is None:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def last(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def push(name: str):
        nonlocal count
        where.setdefault(name, []).append(len(stack))
        elements.append([name, stack[-1][1] if stack else -1, len(lines), None])
        stack.append((name, len(elements) - 1))
        if name in ("article", "main"):
            count += 1
            parts.append(count)

    def end(place: int):
        """The element at this place ends, and those in it."""
        nonlocal skipped
        while len(stack) > place:
            name, k = stack.pop()
            where[name].pop()
            elements[k][3] = len(lines)
            if name in ("article", "main"):
                parts.pop()
        if skipped is not None and place <= skipped:
            skipped = None

    def ended_by(name: str) -> int:
        """The place of the outermost element that this start tag ends."""
        place = len(stack)
        if name in ENDS_P and last(("p",)) > last((*CELLS, "button")):
            place = last(("p",))
        if name in ENDS:
            ends, fence = ENDS[name][0], last(ENDS[name][1])
            place = min([place, *(where[n][-1] for n in ends if where.get(n) and where[n][-1] > fence)])
        if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
            place = min(place, len(stack) - 1)
        return place

    at = 0
    for start, stop, data, name, closing, attributes in tokens(page):
        add(page[at:start])
        at = stop
        if not name:                          # comment, declaration, raw text
            if skipped is None and data:
                add(data)
            continue
        empty = name in VOID or attributes.endswith("/")
        if skipped is None:
            if name == "a":
                in_link = not closing
            if name == "br":
                add(" ")
            elif name in BLOCKS:
                end_line()
        if closing:
            place = last(HEADINGS if name in HEADINGS else (name,))
            fence = (-1 if name in ("article", "main", "body", "html", "table") else last(("table",)) if name in ENDS["tbody"][0]
                     else last((*CELLS, "ul", "ol", "menu", "dir")) if name == "li" else last(CELLS))
            if place > fence:
                end(place)
            continue
        end(ended_by(name))
        if empty:
            continue
        if skipped is None and filters and (name in LEFT_OUT or name == "header" and not parts or filters > 1 and name not in (
                "body", "html", "main") and _marked(name, attributes, bool(parts))):
            if name not in BLOCKS:
                end_line()
            lines.extend([("", 0, parts[-1] if parts else 0, -1)] * GAP)
            push(name)
            skipped = len(stack) - 1
            in_link = False
        elif name in BLOCKS or skipped is not None and (name in LEFT_OUT or name == stack[skipped][0]):
            push(name)
    add(page[at:])
    end_line()
    end(0)
    return lines, elements


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether class, id, role or style say that this element is no text of the page."""
    if not attributes:
        return False
    if NOT_SHOWN.search(attributes) or HIDDEN.search(QUOTED.sub("", attributes)):
        return True
    for value in ATTRIBUTE.findall(attributes):
        for word in value.strip("\"'").lower().split():
            pieces = re.split("[_-]", word)
            marks = [p for p in pieces if p in MARKS]
            names = () if "header" in marks or "hidden" in marks else NEUTRAL_NAMES if LAYOUT.intersection(marks) else NEUTRAL_NAMES | NEUTRAL_PARTS
            if (marks and all(p in MARKS or p in names or NEUTRAL.fullmatch(p) for p in pieces) and not (inside and "header" in marks)
                    and (name != "article" or word in MARKS)):
                return True
    return False


def passages(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[first, last) of the lines between each surge of the window sums and the dive that follows it."""
    n = len(lengths)
    sums = [sum(lengths[i:i + window]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if sums[i] >= surge and lengths[i]:
            j = i
            while j < n and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text of the page's articles, else of its content, blocks joined by line breaks."""
    for filters in (2, 1, 0):
        lines, elements = lines_of(page, filters)
        if any(line[0] for line in lines):
            break
    else:
        return ""
    marked = [t for t, _, part, _ in lines if part and t]
    if marked:
        # a mark-up that names its articles is believed: short passages of them are text as well
        return "\n".join(marked)
    lengths = [len(line[0]) for line in lines]

    def plain(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Without link lists, unless there is nothing else."""
        return [(a, b) for a, b in found if 2 * sum(line[1] for line in lines[a:b]) <= sum(lengths[a:b])] or found

    found = plain(passages(lengths, window, surge) or passages(lengths, window, 1))
    first, after = found[0][0], found[-1][1]
    end = max(i for i in range(first, after) if lengths[i]) + 1
    holder = lines[first][3]
    while holder >= 0 and (elements[holder][0] not in HOLDERS or elements[holder][3] < end):
        holder = elements[holder][1]
    if holder >= 0 and elements[holder][0] not in ("body", "html"):
        first, after = min(first, elements[holder][2]), max(after, elements[holder][3])
    kept = plain([(first + a, first + b) for a, b in passages(lengths[first:after], window, 1)])
    return "\n".join(t for a, b in kept for t, *_ in lines[a:b] if t)


def extract(pages: DataFrame, html_col: str = "html", keep_html: bool = True) -> DataFrame:
    """``pages`` with text and n_chars (code points)."""
    pages = pages.drop(*[c for c in pages.columns if c in ("text", "n_chars") and c != html_col])
    names = pages.columns
    plain = [c for c in names if (keep_html or c != html_col) and c not in ("text", "n_chars")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name in plain)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) if x else "" for x in part.column(names.index(html_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in plain), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=plain + ["text", "n_chars"])
    return pages.mapInArrow(run, fields + "text string, n_chars bigint")
