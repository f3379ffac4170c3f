"""Main-text extraction by line-block distribution.

Markup is stripped to *lines*: one per block of the page, with white space
folded and character references decoded.  Menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments give
lines of length zero (unless such an element holds most of the page's text, as a
form around a whole page does), and so do blocks that are nearly all links.  Text lengths
are summed over sliding windows of lines; the first window whose sum surges
above a threshold, and the point where the sums dive below a quarter of what is
usual since, bound the main text, and every line with text between them is kept.
A later surge to half of the usual sum takes the dive back.  Short lines right
after the dive stay where they are paragraphs or blocks of the kind of the text.
Where the page marks its article, lines outside it have length zero, and all
lines in it are kept: the marks then stand in for surge and dive.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from culprit.llm.common import arrow_map

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
#: Tags that end at the first ">": for the rest of a page whose quotes leave a tag without an end.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(\S*+)))?+")
_WORD = (
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|side-?bar|menu\w*|nav|navbar|navigation|breadcrumbs?|"
    r"footer|header|masthead|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|signup|comments?|disqus|replies|"
    r"share|sharing|social|related|recommend\w*|widgets?|toolbar|pagination|pager|search|login|alert|complementary|contentinfo)"
)
#: A whole token of a class, id or role: a word, perhaps with a place before it and a kind of box, a place or a number after it.
_HINT = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary)[_-])?" + _WORD + r"(?:[_-](?:" + _WORD + r"|"
    r"bar|box|buttons?|links?|list|items?|slot|unit|wrapper|wrap|container|block|section|area|panel|message|form|icons?|left|right|top|bottom|\d+))*(?=$|\s)",
    re.I,
)
_COMMENTS = re.compile(r"comments?|disqus|replies", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg math object xmp noembed noframes canvas audio video".split())
_BOILER = frozenset("head nav aside footer button select menu dialog fieldset title label datalist".split())
_HINTED = frozenset("div section ul ol p span table td tr li dl figure article header details center".split())
_HEADING = frozenset(("h1", "h2", "h3"))
#: Blocks that are text even if they are one link.
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())


def _hinted(attrs: str) -> str:
    """The first hint of a class, id or role, or the empty string."""
    found = (_HINT.search(a or b or c) for name, a, b, c in _ATTR.findall(attrs) if name.lower() in ("class", "id", "role"))
    return next((m[0] for m in found if m), "")


def _hinted_lines(lines: list[tuple[str, int, str]], under: list[tuple[int, ...]], hints: list[str]) -> list[bool]:
    """Whether a line loses its length to a hint: not where the hinted element holds most of the page's paragraph text.

    Reader comments may be longer than the text they are about, so their hint is overruled only where nothing else is left.
    """
    count = [abs(n) if g == "p" else 0 for _, n, g in lines]
    if not any(count):
        count = [abs(n) for _, n, _ in lines]
    held = [0] * len(hints)
    for n, of in zip(count, under, strict=True):
        for h in of:
            held[h] += n
    total = sum(count)
    kept = [2 * n > total and (n == total or not _COMMENTS.search(hint)) for n, hint in zip(held, hints, strict=True)]
    return [not all(kept[h] for h in of) for of in under]


def lines_of(html: str) -> tuple[list[tuple[str, int, str]], bool]:
    """Lines as ``(text, length that counts, block tag)``; whether the page marks an article.

    The length is negative for a paragraph that is one link: it counts for no
    window, but stays where it stands between others of the text.
    """
    lines: list[tuple[str, int, str]] = []
    inside: list[bool] = []
    under: list[tuple[int, ...]] = []
    hints: list[str] = []
    open_hints: list[list] = []  # tag, depth, number of the hint
    buffer: list[str] = []
    linked = 0
    anchor = article = 0
    marked = False
    tag_now = ""
    skip, depth = "", 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                link = linked * 10 >= 8 * len(text)
                lines.append((text, (-len(text) if tag_now in _PARAGRAPH else 0) if link else len(text), tag_now))
                inside.append(article > 0)
                under.append(tuple(h[2] for h in open_hints))
            buffer.clear()
        linked = 0

    at, end = 0, len(html)
    token = _TOKEN
    while at < end:
        m = token.search(html, at)
        if m and m.end() == end and html[end - 1] != ">" and not m[0].startswith("<!--"):
            if token is _TOKEN and ">" in m[0]:
                token = _PLAIN
                continue
            m = None
        stop = m.start() if m else end
        if stop > at and not skip:
            piece = html[at:stop]
            buffer.append(piece)
            if anchor:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing, attrs = name.lower(), bool(m[1]), m[3]
        if skip:
            landmark = name in ("article", "main") and not (name == skip)
            if name == skip:
                depth += -1 if closing else 0 if attrs.endswith("/") else 1
            if depth <= 0 or (landmark and not closing):
                skip = ""
                if not landmark:
                    continue
            elif landmark and closing and article:
                skip = ""
            else:
                continue
        if name in _RAW:
            flush() if name not in ("svg", "math", "canvas", "object") else None
            if not closing and not attrs.endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = close.end() if close else (end if name in ("script", "style", "template", "textarea") else at)
            continue
        if open_hints and (name in ("article", "main") or any(h[0] == name for h in open_hints)):
            flush()
            tag_now = "" if name in _BLOCK else tag_now
            top = max((k for k, h in enumerate(open_hints) if h[0] == name), default=-1)
            if top >= 0 and not (attrs.endswith("/") and not closing):
                open_hints[top][1] += -1 if closing else 1
                if not open_hints[top][1]:
                    del open_hints[top:]
            elif top < 0 and (not closing or article):
                open_hints.clear()
        if name == "a":
            anchor = 0 if closing else int("href" in attrs.lower())
            continue
        if name in _BLOCK:
            flush()
            tag_now = "" if closing else name
            if closing or name in _PARAGRAPH:  # a link that nothing closes ends with its block
                anchor = 0
        if closing:
            if name in ("article", "main") and article:
                article -= 1
            continue
        if name in _VOID:
            continue
        boiler = name in _BOILER or (name == "header" and not article) or (name == "form" and article > 0)
        hint = "form" if name == "form" and not boiler else _hinted(attrs) if attrs and not boiler and name in _HINTED else ""
        if hint and not attrs.endswith("/"):
            flush()
            if open_hints and open_hints[-1][0] == name:
                open_hints[-1][1] -= 1
            open_hints.append([name, 1, len(hints)])
            hints.append(hint)
            anchor = 0
        elif boiler and not attrs.endswith("/"):
            flush()
            skip, depth = name, 1
            anchor = 0
        if name in ("article", "main") and not boiler and not hint:
            article += 1
            marked = True
    flush()
    if hints:
        gone = _hinted_lines(lines, under, hints)
        lines = [(t, 0 if x else n, g) for (t, n, g), x in zip(lines, gone, strict=True)]
        inside = [i and not x for i, x in zip(inside, gone, strict=True)]
    if marked and any(i and t for (t, _, _), i in zip(lines, inside, strict=True)):
        return [(t, len(t) if i else 0, g) for (t, _, g), i in zip(lines, inside, strict=True)], True
    return lines, False


def dive(size: list[int], tags: list[str], sums: list[int], first: int, width: int, need: int) -> int:
    """The line where the text that begins at ``first`` ends for good."""
    surges = sorted(s for s in sums[first:] if s >= need)
    usual = surges[len(surges) // 2] if surges else need
    low, again = max(usual // 4, min(need, usual)), max(usual // 2, min(need, usual))
    end, at, open_ = first + 1, first, True
    while at < len(size):
        # one long line fills every window over it: the text ends with the last line that alone keeps the sum up
        if open_ and sums[at] < low:
            open_ = False
        elif not open_ and sums[at] >= again:
            open_ = True
        if open_:
            reach = range(at, min(at + width, len(size)))
            end = max(end, 1 + max((k for k in reach if size[k] * width >= low), default=at))
        at += 1
    kinds = {"p", *(tags[k] for k in range(first, end) if size[k] * width >= low)}
    for k in range(end, min(end + width - 1, len(size))):
        if not size[k] or tags[k] not in kinds:
            break
        end = k + 1
    return end


def main_text(html: str, *, width: int = 3, surge: int = 80) -> str:
    """The text between surge and dive, one line per block."""
    lines, marked = lines_of(html)
    if not lines:
        return ""
    size = [max(n, 0) for _, n, _ in lines]
    if marked:
        return "\n".join(t for t, n, _ in lines if n)
    sums = [sum(size[k : k + width]) for k in range(len(size))]
    need = min(surge, max(sums) or 1)
    first = next((k for k, s in enumerate(sums) if s >= need), None)
    if first is None:
        return ""
    while not size[first]:
        first += 1
    end = dive(size, [g for _, _, g in lines], sums, first, width, need)
    while first and lines[first - 1][2] in _HEADING and size[first - 1]:
        first -= 1
    return "\n".join(t for t, n, _ in lines[first:end] if n)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page, without a shuffle.

    Null and empty html give an empty text; null ids and urls are carried; rows
    that repeat each give a row; an empty table gives an empty result; other
    columns, whatever their names, are ignored.  A page of any length is read
    whole, in time and memory that grow with its length.  Returns ``page_id, url, text, n_chars``.
    """
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make():
        def step(batch):
            found = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield {"page_id": batch.column(0), "url": batch.column(1).cast(pa.string()), "text": found, "n_chars": list(map(len, found))}

        return step

    picked = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return arrow_map(picked, "page_id long, url string, text string, n_chars long", make, out)
