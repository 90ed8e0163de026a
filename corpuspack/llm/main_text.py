"""Operator 6: main text of web pages by line-block distribution.

1. Markup is stripped: a page becomes lines, one for each block of text in page order. The text of
   menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
   (known by element, role, class or id) counts as empty lines, and so do borders of containers. A class or id
   is read like a compound noun: ``reader-comments`` are comments, ``social-costs`` are costs. Whatever its name, an element
   that holds most of the page's text outside links stays.
2. The length of a line is its characters, in pages without an article element only those outside
   links. ``WINDOW`` neighbouring lines' lengths add up to the line-block distribution.
3. Text begins where the distribution surges, that is rises above the threshold with text in the next
   blocks too, and ends where it dives to nothing. Runs between surge and dive are kept if they have a
   quarter of the longest run's characters. Every shorter run, also one that never surges, is kept if most of
   it is not links and it stands between kept runs, in the container around the longest run (the nearest one
   that holds other runs, below the body), or has a sentence that is no copyright line or marked advert.

Where the page names its article (``article``, ``main`` or the role), lines outside it are empty and the
threshold is one character, so the article is kept to its shortest line; runs of it that are lists of links go.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86
RUN_SHARE = 0.25
#: A short run with a larger share of its characters in links is a list of links.
LINK_SHARE = 0.5
#: A run of an article with so many lines, this share of them in links, is a list of links.
LIST_LINES, LIST_SHARE = 3, 0.9
#: Comments may hold more text than the article, if that has this many characters and a twentieth of theirs.
LEAST_ARTICLE = 60

# HTML's element names by what they mean here, and words of classes and ids.
RAW = frozenset("script style textarea iframe noembed noframes".split())
#: Markup inside, but no text of the page; one that is never closed ends at the next block or with its parent.
SKIPPED = frozenset("noscript template svg math canvas object audio video".split())
BOILERPLATE = frozenset("head nav footer aside form button select datalist menu dialog fieldset label input".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "tfoot thead title tr ul".split()
)
CONTAINERS = frozenset("div section table ul ol dl body main article aside header footer nav form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination "
    "pager footer footnav copyright comment comments commentlist respond disqus replies share sharing social related recommended "
    "newsletter subscribe subscription signup login search searchbox widget widgets toolbar skip paywall".split()
)
#: Of these, adverts and readers' comments: the former on any element but headings, the latter however much text they hold.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
COMMENTS = frozenset("comment comments commentlist respond disqus replies".split())
#: Words behind a name that leave it what it is (``ad-box``, ``comment-thread``); others make it their own (``social-costs``).
NEUTRAL = frozenset(
    "area bar block box button buttons container content form inner item items label left link links list module outer panel region right section "
    "slot text thread title top trail unit wrap wrapper bottom".split()
)
#: Words before a name that leave it what it is (``reader-comments``).
QUALIFIERS = frozenset(
    "article author blog body desktop entry fixed floating global header inline left main mobile news page post primary reader right secondary site sticky top "
    "user bottom".split()
)
#: ``related-posts``: pages elsewhere, unlike ``related-work``.
ELSEWHERE = frozenset("related recommended popular trending suggested".split())
PAGES = frozenset("articles content links news pages posts reading stories topics videos".split())
#: Only outside the article: inside it they may name its own parts.
NAMED_OUTSIDE = frozenset("header masthead topbar logo branding".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*))>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^a-zA-Z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip(" /") else {}


def _tokens(page: str) -> list[tuple[str, str, str]]:
    """``(kind, name or text, attributes)`` in page order; kind is text, open or close."""
    out, at, n = [], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            out.append(("text", page[at:], ""))
            break
        if m.start() > at:
            out.append(("text", page[at : m.start()], ""))
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            out.append(("close", name, ""))
        else:
            out.append(("open", name, attributes))
            if name in RAW and not attributes.endswith("/"):  # text up to the end tag is not markup
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                if end or name in ("script", "style", "textarea"):
                    at = end.end() if end else n
                out.append(("close", name, ""))
    return out


def _pairs(tokens: list[tuple[str, str, str]]) -> dict[int, int]:
    """The end tag of each start tag that has one (of the last open element of its name)."""
    waiting: dict[str, list[int]] = {}
    out = {}
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open" and name not in VOID and not (name in SKIPPED and tokens[i][2].endswith("/")):
            waiting.setdefault(name, []).append(i)
        elif kind == "close" and waiting.get(name):
            out[waiting[name].pop()] = i
    return out


def _head(token: str, names: frozenset) -> str | None:
    """What a class or id names, if it is boilerplate: the noun of the compound, with words around it that change nothing."""
    words = [w for w in _WORDS.split(token) if w]
    words = [w for part in words for w in _HUMP.sub("-", part).lower().split("-")]
    if len(words) > 1 and words[0] in ELSEWHERE and words[-1] in PAGES:
        return words[0]
    last = len(words)
    while last and words[last - 1] in NEUTRAL and words[last - 1] not in names:
        last -= 1
    if not last or words[last - 1] not in names:
        return None
    return words[last - 1] if all(w in names or w in NEUTRAL or w in QUALIFIERS for w in words[: last - 1]) else None


def _heads(attributes: dict[str, str], names: frozenset = NAMED) -> set[str]:
    given = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return {h for own in given if (h := _head(own, names))}


def _by_element(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Boilerplate by element, role or being hidden."""
    if name in BOILERPLATE or name in RAW or name in SKIPPED or (name == "header" and not inside):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    return attributes.get("role", "").lower() in ROLES


def _by_name(name: str, attributes: dict[str, str], inside: bool) -> set[str]:
    """What boilerplate the class or id says that an element is: containers by any name, other elements than headings
    by those of adverts. Headings and paragraphs are named by their subject."""
    if name in HEADINGS or not ("class" in attributes or "id" in attributes):
        return set()
    heads = _heads(attributes, NAMED if inside else NAMED | NAMED_OUTSIDE)
    return heads if name in CONTAINERS else heads & ADVERTS


def page_lines(page: str) -> tuple[list[str], np.ndarray, bool, list[int], list[tuple[int, int]], np.ndarray]:
    """The lines of a page, their lengths for the distribution, whether it names its article, the lines' places among
    the tokens, the places where each container below the body begins and ends, and the lines' characters in links."""
    tokens = _tokens(page)
    ends = _pairs(tokens)
    opens = [(i, t[1], _attributes(t[2])) for i, t in enumerate(tokens) if t[0] == "open"]
    last = len(tokens)
    starts = {j: i for i, j in ends.items()}

    def regions(test) -> list[tuple[int, int]]:
        return [(i, ends.get(i, last)) for i, name, attributes in opens if test(name, attributes)]

    def is_article(name, own):  # a comment may be an article of its own
        return (name == "article" or own.get("role", "").lower() == "article") and not _heads(own)

    articles = regions(is_article) or regions(lambda name, own: name == "main" or own.get("role", "").lower() == "main")
    inside = np.zeros(last + 1, dtype=bool)
    for i, j in articles:
        inside[i:j] = True
    first_article = articles[0][0] if articles else -1
    article_starts = [i for i, _ in articles]
    dropped = np.zeros(last + 1, dtype=bool)

    def drop(test) -> None:
        bound = 0
        for i, name, attributes in opens:
            if i < bound or dropped[i] or (name in ("html", "body", "article", "main") and not (name == "article" and _heads(attributes))):
                continue
            j = i + 1 if name in VOID else ends.get(i)
            found = test(i, j, name, attributes)
            if not found:
                continue
            if j is None and name in SKIPPED:
                j = i + 1
                while not tokens[i][2].endswith("/") and j < last:
                    kind, other, _ = tokens[j]
                    if (kind == "open" and other in BLOCKS and other != "title") or (kind == "close" and starts.get(j, i) < i):
                        break
                    j += 1
            # without an end, or around an article
            if j is None or (not inside[i] and bisect_right(article_starts, i) < bisect_left(article_starts, j)):
                continue
            dropped[i:j] = True
            bound = j

    drop(lambda i, j, name, own: _by_element(name, own, bool(inside[i])))
    plain = _plain_text(tokens, dropped, inside if articles else None)
    total = int(plain[-1])

    def named_so(i, j, name, own):
        heads = _by_name(name, own, bool(inside[i]))
        held = int(plain[j] - plain[i]) if heads and j is not None else 0
        rest = total - held
        return heads and (held <= rest or bool(heads & COMMENTS and rest >= LEAST_ARTICLE and held < 20 * rest))

    drop(named_so)
    if articles and all(dropped[i:j].all() for i, j in articles):
        inside[:], first_article = False, -1
    named = first_article >= 0

    lines: list[str] = []
    lengths: list[int] = []
    in_links: list[int] = []
    places: list[int] = []
    words: list[str] = []
    linked = 0
    links = 0

    def end_line():
        nonlocal words, linked
        text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
        if text:
            lines.append(text)
            lengths.append(len(text) if named else max(0, len(text) - linked))
            in_links.append(min(linked, len(text)))
            places.append(i)
        words, linked = [], 0

    def gap():
        lines.append("")
        lengths.append(0)
        in_links.append(0)
        places.append(i)

    i = 0
    for i, (kind, name, _) in enumerate(tokens):
        if dropped[i] or (named and not inside[i]):
            if words:
                end_line()
            if not lines or lines[-1]:
                gap()
                gap()
            continue
        if kind == "text":
            words.append(name)
            if links:
                linked += len(name.strip())
            continue
        if name == "a":
            links = max(0, links + (1 if kind == "open" else -1))
        elif name in ("td", "th"):
            words.append(" ")
        elif name in BLOCKS:
            end_line()
            if name in CONTAINERS:  # two borders in a row are as wide as a window and part runs
                gap()
                gap()
    end_line()
    spans = [(k, ends[k]) for k, name, _ in opens if name in CONTAINERS and name != "body" and k in ends]
    return lines, np.array(lengths, dtype=np.int64), named, places, spans, np.array(in_links, dtype=np.int64)


def _plain_text(tokens: list[tuple[str, str, str]], dropped: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
    """Characters of text outside links (and outside what is dropped, and inside the article if there is one) before each token."""
    sizes, links = np.zeros(len(tokens) + 1, dtype=np.int64), 0
    for i, (kind, name, _) in enumerate(tokens):
        if kind != "text":
            links = max(0, links + (name == "a") * (1 if kind == "open" else -1))
        elif not links and not dropped[i] and (inside is None or inside[i]):
            sizes[i + 1] = len(name.strip())
    return np.cumsum(sizes)


def runs(lengths: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """The runs of lines between surge and dive of the line-block distribution."""
    n = len(lengths)
    sums = np.convolve(lengths, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :][:n] if n else lengths  # block i: lines i to i + WINDOW - 1
    out, i = [], 0
    while i < n:
        if sums[i] < threshold or not lengths[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        out.append((i, j))
        i = j + 1
    return out


_SENTENCE = re.compile(r"(?:\S+\s+){4,}\S+[.!?…。！？][\"'”’»)]*(?:\s|\Z)")


#: Lines of this form are no sentence of the text.
_IMPRINT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved|advertisement\b|sponsored\b|anzeige\b|publicité\b|publicidad\b)", re.IGNORECASE)


def _has_sentence(lines: list[str]) -> bool:
    return any(_SENTENCE.search(line) and not _IMPRINT.match(line) for line in lines)


def with_short_runs(kept: list[tuple[int, int]], lines: list[str], lengths: np.ndarray, places: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``kept`` runs and the shorter ones that belong to their text, in page order."""
    rest, at = [], 0
    for a, b in runs(lengths, 1):  # what the kept runs leave of each stretch of text
        while at < len(kept) and kept[at][0] < b:
            rest.append((a, kept[at][0]))
            a = max(a, kept[at][1])
            at += 1
        rest.append((a, b))
    rest = [(a, b) for a, b in rest if a < b and lengths[a:b].sum() > (1 - LINK_SHARE) * sum(map(len, lines[a:b]))]
    a, b = max(kept, key=lambda r: lengths[r[0] : r[1]].sum())
    text = [k for k in range(a, b) if lines[k]]
    first, last = places[text[0]], places[text[-1]]
    others = [[places[k] for k in range(x, y) if lines[k]] for x, y in rest]
    # the containers around the longest run lie in each other: the smallest one that holds another run
    nested = sorted((s for s in spans if s[0] <= first and last <= s[1]), key=lambda s: s[1] - s[0])
    begins, stops = [-i for i, _ in nested], [j for _, j in nested]
    near = [max(bisect_left(begins, -own[0]), bisect_left(stops, own[-1])) for own in others if own]
    around = nested[min(near)] if near and min(near) < len(nested) else (0, -1)
    start, stop, more = kept[0][0], kept[-1][1], []
    for (x, y), own in zip(rest, others):
        inside = bool(own) and around[0] <= own[0] and own[-1] <= around[1]
        if (inside and not all(_IMPRINT.match(line) for line in lines[x:y] if line)) or start <= x < stop or _has_sentence(lines[x:y]):
            more.append((x, y))
    return sorted(kept + more)


def without_link_lists(kept: list[tuple[int, int]], lines: list[str], in_links: np.ndarray) -> list[tuple[int, int]]:
    """The runs of an article without their lists of links: three lines or more, nearly all of it links, no sentence."""
    out = []
    for a, b in kept:
        borders = [a - 1, *(k for k in range(a, b) if not lines[k]), b]
        for x, y in zip(borders, borders[1:]):  # stretches between borders of containers
            own = lines[x + 1 : y]
            listed = len(own) >= LIST_LINES and in_links[x + 1 : y].sum() >= LIST_SHARE * sum(map(len, own)) and not _has_sentence(own)
            if own and not listed:
                out.append((x + 1, y))
    return out or kept


def main_text(page: str | None) -> str:
    """The main text of one page (null: empty)."""
    if not page:
        return ""
    lines, lengths, named, places, spans, in_links = page_lines(page)
    if not lengths.any():
        return ""
    if named:
        kept = without_link_lists(runs(lengths, 1), lines, in_links)
    else:
        blocks = np.convolve(lengths, np.ones(WINDOW, dtype=np.int64))
        kept = runs(lengths, int(min(SURGE, max(1, blocks.max() // 2))))
        sizes = [lengths[a:b].sum() for a, b in kept]
        least = RUN_SHARE * max(sizes)
        kept = [r for r, size in zip(kept, sizes) if size >= least]
        kept = with_short_runs(kept, lines, lengths, places, spans)
    return "\n".join(line for a, b in kept for line in lines[a:b] if line)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page; ``text`` is empty where there is none.

    Null ``html`` gives an empty text, null ``page_id`` and ``url`` stay null, repeated pages give their rows
    again, other columns are ignored, and no pages give no rows. Whatever the markup, no page is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    frame = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return frame.mapInArrow(run, "page_id long, url string, text string, n_chars long")
