"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one for each block of text. Over a sliding window of lines the text lengths are summed;
where the sum jumps from nothing the text surges, where it falls to nothing again it dives, and what lies between a
surge and its dive is one run (Chen 2010, "Extracting main text by line-block distribution"). Elements that never hold
the article (menus, headers, footers, forms, adverts, comments, ...) leave as many blank lines as the window is long, so
runs end at them and short paragraphs at the edge of an article are not cut off. <article> and <main> weigh in the choice
of runs, but do not make it. No name decides alone: an element that its tag or class sets aside stays if it holds the
page's text (see `wrappers`).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
# Fixed values of HTML: elements without running text, elements beside the article, elements that stay within a line,
# and elements without an end tag.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "canvas", "audio", "video"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meta", "link", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words in class, id or role that mark such elements.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "copyright", "sidebar", "widget", "related", "recommended", "share", "sharing", "social",
    "comment", "comments", "reply", "replies", "respond", "disqus", "skip", "toolbar", "search", "complementary", "contentinfo",
}
# Those that also name subjects: in an article they decide only together with the lines of the block.
GENERIC = {"notice", "banner", "promotion", "header", "masthead", "copyright", "menu", "nav", "navigation", "pager", "sidebar", "widget", "related", "recommended", "share", "sharing", "social", "reply", "replies", "respond", "skip", "toolbar", "search", "complementary", "popup", "modal", "consent", "footer"}
PLAIN_MARKS = MARKS - GENERIC
WITHIN = {"article", "main"}
# Elements that never hold an article, and words for what readers, advertisers and the site itself say.
NEVER = {"nav", "footer", "button", "select", "dialog", "menu"}
TALK = {"comment", "comments", "reply", "replies", "respond", "disqus"}
FOREIGN = TALK | {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login"}
PROSE = {"p", "blockquote", "pre"}
HEADING = re.compile(r"h[1-6]")
REFERENCES = re.compile(r"\b(references|sources|bibliography|literature|notes|footnotes|citations|works cited|further reading|external links)\b", re.I)
RIGHTS = re.compile(r"©|\(c\)|\bcopyright\b|\ball rights\b", re.I)
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)]*\Z")
SHORT = 25  # characters of a line that is no sentence
# A tag ends at its ">", or where the next one begins; a quote that is not closed before that is a plain character. No part
# is read twice, so the time is in proportion to the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|(?=<)|\Z)", re.S)
RAW_END = {name: re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I) for name in RAW}
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")


def marked(attrs: str, words: set[str] = MARKS, whole: bool = False) -> bool:
    """Whether class, id or role has one of words as a word, or as a whole name, or the element is hidden."""
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and not words.isdisjoint(value.split() if whole else WORD.findall(value)):
            return True
    return False


def wrappers(page: str) -> set[int]:
    """Places of the tags whose name or class would set them aside although they hold the article.

    Such an element holds half of the page's text outside of links and of what never is the article, and either an h1, or
    else <article> and <main> outside of it hold less than a quarter. One with a word for comments, adverts or notices has
    to hold an h1 or a <main> too, unless there is no other text and the word is part of a longer one (`no-comments`).
    """
    stack: list[tuple] = []  # name, place, kind, counts when it began
    found = []
    whole = base = inner = heads = mains = 0  # characters; those outside of FOREIGN and NEVER; of these, those in WITHIN
    foreign = within = link = at = 0
    names: dict[str, int] = {}

    def end(k: int):
        nonlocal foreign, within
        for name, place, kind, *began in stack[k:]:
            names[name] -= 1
            within -= name in WITHIN
            foreign -= kind in ("never", "foreign", "part")
            if kind in ("weak", "foreign", "part"):
                found.append((place, kind, *(now - then for now, then in zip((whole, base, inner, heads, mains), began))))
        del stack[k:]

    while m := TOKEN.search(page, at):
        size = 0 if link else len(page[at : m.start()].strip())
        whole, base, inner = whole + size, base + (0 if foreign else size), inner + (size if within and not foreign else 0)
        at = m.end()
        name = (m[2] or "").lower()
        if not m[1] and name in RAW:
            closing = RAW_END[name].search(page, at)
            at = closing.end() if closing else len(page)
        elif name == "a":
            link = 0 if m[1] else 1
        elif not name or name in INLINE or name in VOID or name in ("p", "html", "body"):
            continue
        elif m[1]:
            if names.get(name):
                end(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        elif not m[3].endswith("/"):
            kind = ""
            if name in NEVER or marked(m[3], set()):
                kind = "never"
            elif name not in WITHIN and marked(m[3], FOREIGN):
                kind = "foreign" if marked(m[3], FOREIGN, whole=True) else "part"
            elif name in ASIDE or name not in WITHIN and marked(m[3]):
                kind = "weak"
            stack.append((name, m.start(), kind, whole, base, inner, heads, mains))
            names[name] = names.get(name, 0) + 1
            foreign += kind in ("never", "foreign", "part")
            within += name in WITHIN
            heads += name == "h1"
            mains += name == "main"
    size = 0 if link else len(page[at:].strip())
    whole, base, inner = whole + size, base + (0 if foreign else size), inner + (size if within and not foreign else 0)
    end(0)
    out = set()
    for place, kind, a, b, c, h1, main in found:
        if kind == "weak":
            holds = b and 2 * b >= base and (h1 or 4 * (inner - c) < base)
        else:
            holds = 2 * a >= whole and (h1 or main or kind == "part" and base < SHORT <= a)
        if holds:
            out.add(place)
    return out


class Line(NamedTuple):
    raw: str | None  # None: a blank line that ends a run
    element: int = 0  # the innermost open one, 0 for the page
    region: int = 0  # the innermost article or main, 0 outside
    linked: int = 0  # characters in links
    doubt: int = 0  # the block in an article that a generic word marks, 0 if none
    title: bool = False  # in a h1
    tag: str = ""  # name of that element


def lines_of(page: str, parent: list[int], last: list[int]) -> Iterator[Line]:
    """Blocks in page order; WINDOW blank lines stand for an element beside the article, and at the borders of article and main.

    Elements are numbered as they begin, so those within one are the numbers up to its last. parent and last, each with an
    entry for the page in front, are filled meanwhile.
    """
    holds = wrappers(page)
    stack: list[tuple[str, bool, int]] = []  # open elements that are not inline, whether each is beside the article, its number
    regions: list[int] = []
    doubts: list[int] = []
    beside = link = linked = made = 0
    parts: list[str] = []
    at, n = 0, len(page)
    names: dict[str, int] = {}  # how many open elements have each name
    blank = [Line(None)] * WINDOW

    def flush():
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        tag, _, element = stack[-1] if stack else ("", False, 0)
        out = Line(text, element, regions[-1] if regions else 0, linked, doubts[0] if doubts else 0, names.get("h1", 0) > 0, tag)
        linked = 0
        return out

    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not beside:
            parts.append(text)
            linked += len(text.strip()) if link else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1] and name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        if name == "a":
            link = 0 if m[1] else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE and not names.get(name) and not (not m[1] and marked(m[3])):
            continue
        if name in INLINE and not m[1] and not marked(m[3]):  # within a marked one of its name, whose end is still to come
            if name not in VOID and not m[3].endswith("/"):
                stack.append((name, False, stack[-1][2]))
                names[name] += 1
            continue
        if name in INLINE and m[1] and not next(x[1] for x in reversed(stack) if x[0] == name):
            del stack[next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)]
            names[name] -= 1
            continue
        plain = PLAIN_MARKS - TALK if name == "p" else PLAIN_MARKS
        generic = not m[1] and bool(regions) and not beside and name not in ASIDE | WITHIN and m.start() not in holds and marked(m[3]) and not marked(m[3], plain)
        if generic and name in INLINE and "".join(parts).strip():  # amid a sentence
            continue
        if m[1]:  # an end tag closes the nearest element of its name and all left open within
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name) if names.get(name) else None
            if k is None:
                if name not in INLINE:
                    yield flush()
                continue
            yield flush()
            ends = False
            for tag, off, number in stack[k:]:
                names[tag] -= 1
                last[number] = made
                beside -= off
                ends |= off
                if regions and regions[-1] == number:
                    regions.pop()
                    ends = True
                if doubts and doubts[-1] == number:
                    doubts.pop()
            if ends and not beside:
                yield from blank
            del stack[k:]
            continue
        yield flush()
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p":  # a paragraph ends an open one
            while stack and stack[-1][:2] == ("p", False):
                number = stack.pop()[2]
                names["p"] -= 1
                last[number] = made
                if doubts and doubts[-1] == number:
                    doubts.pop()
        off = m.start() not in holds and (name in ASIDE or (name not in ("body", "html", "article", "main") and not generic and marked(m[3])))
        if name in ("body", "html"):  # the page itself
            stack.append((name, False, 0))
            names[name] = names.get(name, 0) + 1
            continue
        made += 1
        parent.append(stack[-1][2] if stack else 0)
        last.append(-1)
        if (off or name in WITHIN) and not beside:
            yield from blank
        stack.append((name, off, made))
        names[name] = names.get(name, 0) + 1
        beside += off
        if name in WITHIN:
            regions.append(made)
        if generic:
            doubts.append(made)
    yield flush()
    for _, _, number in stack:
        last[number] = made
    last[0] = made


def common(elements: list[int], parent: list[int], last: list[int]) -> int:
    """The innermost element that holds all of a run's lines; of a single line, the one around its own block."""
    if len(elements) == 1:
        return parent[elements[0]]
    low, high = min(elements), max(elements)
    while low and last[low] < high:
        low = parent[low]
    return low


def prose(run: list[Line]) -> bool:
    """Whether a run's lines read as part of a text: a paragraph, or a whole sentence, that is no copyright line."""
    return any(not RIGHTS.search(x.raw) and (x.tag in PROSE or len(x.raw) >= SHORT and SENTENCE.search(x.raw)) for x in run)


def main_text(page: str | None, least: int = 120, most_links: float = 0.5) -> str:
    """The article's blocks, character references decoded and white space turned into single spaces, joined by a blank line.

    Runs of lines between surge and dive are kept that weigh at least `least`, or else the heaviest. A run weighs its
    characters outside of links; if one article or main holds half of all runs' characters or more, four times that within
    it and half of it elsewhere; another article or main (a teaser, say) halves a run's weight. Runs that lie in the element
    that holds a kept one are kept with it if only removed elements are between, or if they are prose; so is prose
    in the element next around, if only removed elements are between, and the nearest h1 before the text if that has none.
    All runs of that article or main are kept. Lines that are mostly links neither begin nor end a run, but for these
    in that article or main: fewer than WINDOW in a row, rows of long ones, and lists of references. A block in an article
    or main that a generic word marks is removed if its lines are short or mostly links. Where all text is links, long ones
    count as text.
    """
    if not page:
        return ""
    lines: list[Line] = []
    parent, last = [0], [0]
    for x in lines_of(page, parent, last):
        if x.raw is None:
            lines.append(x)
        elif text := SPACE.sub(" ", html.unescape(x.raw)).strip():
            lines.append(x._replace(raw=text, linked=min(x.linked, len(text))))
    blocks: dict[int, list[Line]] = {}
    for x in lines:
        if x.doubt and x.raw:
            blocks.setdefault(x.doubt, []).append(x)
    out = set()
    for k, own in blocks.items():
        chars, links = sum(len(x.raw) for x in own), sum(x.linked for x in own)
        if any(x.title for x in own):  # the article's heading
            continue
        if links > most_links * chars or chars - links < min(SHORT * len(own), least // 2):
            out.add(k)
    if out:
        lines = [y for x in lines for y in ([Line(None)] * WINDOW if x.doubt in out else [x])]
    # text outside of links; lines that are mostly links add nothing to the window
    sizes = [len(x.raw) - x.linked if x.raw and x.linked <= most_links * len(x.raw) else 0 for x in lines]
    if not any(sizes):
        sizes = [len(x.raw) if x.raw and len(x.raw) >= SHORT else 0 for x in lines]
    total, held = sum(sizes), {}
    for x, own in zip(lines, sizes):
        held[x.region] = held.get(x.region, 0) + own
    story = max((r for r in held if r), key=lambda r: held[r], default=0)
    story = story if story and 2 * held[story] >= total else 0
    weights = list(sizes)
    if story:
        k = 0
        while k < len(lines):  # links in a row
            j = k
            while j < len(lines) and lines[j].raw and lines[j].region == story and not sizes[j]:
                j += 1
            title = lines[k - 1] if k else Line(None)
            cited = title.raw and HEADING.fullmatch(title.tag) and REFERENCES.search(title.raw)
            if 0 < j - k < WINDOW or j > k and (cited or sum(len(x.raw) for x in lines[k:j]) >= SHORT * (j - k)):
                sizes[k:j] = [1] * (j - k)
            k = max(j, k + 1)
    total = sum(sizes[:WINDOW])
    runs, run = [], []
    for k, x in enumerate(lines):
        # total: characters in lines k .. k + WINDOW - 1; 0 is a dive, the next text a surge
        if total and x.raw and (run or sizes[k]):
            run.append(k)
        elif not total and run:
            runs.append(run)
            run = []
        total += (sizes[k + WINDOW] if k + WINDOW < len(sizes) else 0) - sizes[k]
    runs += [run] if run else []
    for r in runs:
        while r and not sizes[r[-1]]:
            r.pop()
    if not runs:
        return ""
    region = [lines[r[0]].region for r in runs]
    factor = [(4 if g == story else 0.5) if story else (0.5 if g else 1) for g in region]
    weigh = [f * sum(weights[k] for k in r) for r, f in zip(runs, factor)]
    good = {k for k, own in enumerate(weigh) if own >= least} or {weigh.index(max(weigh))}
    holder = [common([lines[k].element for k in r], parent, last) for r in runs]
    if story and any(region[k] == story for k in good):
        good |= {k for k, g in enumerate(region) if g == story}

    # spread from kept runs over removed elements, and over links to prose of the same element
    for way in (range(len(runs)), range(len(runs) - 1, -1, -1)):
        near = None  # the nearest kept run
        for k in way:
            if k in good:
                near = k
                continue
            if near is None:
                continue
            if region[k] and region[k] != region[near]:  # a teaser counts as removed
                continue
            a, b = min(k, near), max(k, near)
            between = {i for r in range(a + 1, b) for i in runs[r]}
            split = all(lines[i].raw is None or i in between for i in range(runs[a][-1] + 1, runs[b][0]))
            inside, around = (all(e <= lines[i].element <= last[e] for i in runs[k]) for e in (holder[near], parent[holder[near]]))
            text = prose([lines[i] for i in runs[k]])
            if region[k] == region[near] and (inside and (split or text) or split and around and text):
                good.add(k)
                holder[k], near = holder[near], k
            else:
                near = None
    first = min(good)
    if not any(lines[i].title for k in good for i in runs[k]):
        title = next((k for k in range(first - 1, -1, -1) if any(lines[i].title for i in runs[k]) and region[k] in (0, region[first])), None)
        good |= {title} if title is not None else set()
    return "\n\n".join(lines[i].raw for k in sorted(good) for i in runs[k])


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """All columns of pages and the main text; a column named as `out` is replaced, others stay whatever their names.

    Null or empty html gives an empty text; pages that end within a tag, a comment or an element are read as far as they
    go. Time is in proportion to a page, so a very long one is only slow. Repeated rows get the same text, of runs that
    weigh the same the first; an empty table gives no rows. An element that a tag or class would set aside stays if it
    holds the page's text; where nothing but such elements has text (a menu, hidden parts, comments), the text is empty.
    """

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(main_text, na_action=None)

    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != out.lower()], run(F.col(f"`{html_col}`")).alias(out))
