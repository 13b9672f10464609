"""Main text of web pages by the suffix arrays of their hosts.

A page is read as a sequence of blocks of text (what lies between block tags),
each with what markup says of it: furniture (menus, footers, adverts, forms,
comments and so on, by tag, role, class or id), main (in an article, or in the main part
of the page), or open. The token streams of a host's pages, a mark for each
block and then its words, are concatenated, each page ended by a mark of its own, and
their suffixes are sorted by their first MIN_TOKENS tokens. Neighbours in that
order with the same beginning are occurrences of one substring; the pages they come from are
counted, pages with the same stream once. All windows of a longer repeated substring are
repeated as well, so the tokens in such windows are just those covered by
repeated substrings of that length or more.

Left out are furniture, in pages with a main part all that lies outside of it,
open blocks covered by substrings on a quarter of the host's pages (three
at least), and blocks of the main part covered by substrings on half of them (eight at least)
unless a quarter of the page's main part is, which is then a copy of
other pages and no boilerplate. If nothing would stay of open blocks, they stay.

A host of many pages is split into groups of some two thousand pages; a group is
one task, a small host is one group. What counts is the whole host all the same: its different
streams are dealt to parts, and a substring on a quarter of the host's streams is on a quarter of
the streams of one part at least, so the substrings frequent in some part are all that
can count. Those are then counted in every part, the counts summed, and each
group of pages gets the list of its host.

Defined cases: null or empty html gives an empty text, a null or relative url a host of its
own for each page; repeated rows come out repeatedly; columns other than id, url
and html are ignored; an empty table gives an empty result. Whole html is
read; markup that ends too early, unclosed elements and stray brackets lose no text, and a
tag with an odd quote ends at the next bracket.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

MIN_TOKENS = 8  # shortest substring that counts
OPEN_SHARE, OPEN_PAGES = 4, 3  # boilerplate among open blocks: on 1 of so many pages, and on so many
MAIN_SHARE, MAIN_PAGES, COPY_SHARE = 2, 8, 4
GROUP_PAGES, GROUP_BYTES = 2000, 16 << 20
HOT_HOSTS = 100_000  # hosts of several groups up to which they are broadcast

# Elements by what the standard says of them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas video audio select button datalist".split())
FURNITURE_TAGS = frozenset("nav footer aside form head menu dialog fieldset search option".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
# Words of class and id attributes.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar sidebars aside widget widgets footer masthead topbar comment comments reply replies respond discussion disqus form search login "
    "signup newsletter subscribe subscription cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social "
    "related recommended recommendations pagination pager toolbar copyright legal disclaimer".split()
)
MAIN_WORDS = frozenset("article articlebody post postbody entry story content maincontent maintext bodytext main".split())
# An element of the first kind ends an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset("ul ol dl table".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

FURNITURE, OPEN, CONTENT, ARTICLE = range(4)


def _kind_of(tag: str, attributes: str, outer: int) -> int:
    """What an element's blocks are, by its tag and attributes and by what is around it."""
    if outer == FURNITURE or tag in FURNITURE_TAGS or (tag == "header" and outer < CONTENT):
        return FURNITURE
    kind = ARTICLE if tag == "article" else max(outer, CONTENT) if tag == "main" else outer
    if not attributes.strip(" /\n\t\r"):
        return kind
    found = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        found.setdefault((name or bare).lower(), references.unescape(a or b or c))
    role = found.get("role", "").lower()
    named = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(named)}
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", found.get("style", "")).lower()
    if tag not in ("html", "body", "main", "article") and words & FURNITURE_WORDS and not (tag == "header" and outer >= CONTENT):
        return FURNITURE
    if role in FURNITURE_ROLES or hidden or tag == "article" and words & {"comment", "comments", "reply", "ad", "advert", "promo", "related"}:
        return FURNITURE
    if "articlebody" in found.get("itemprop", "").lower() or role == "article":
        return ARTICLE
    if role == "main" or tag in ("div", "section", "td") and (words & MAIN_WORDS or {w.lower() for w in named.split()} & MAIN_WORDS):
        return max(kind, CONTENT)
    return kind


def blocks_of(page: str) -> list[tuple[int, str, str]]:
    """(kind, tag, text) of each block of text, in page order."""
    out: list[tuple[int, str, str]] = []
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            kind = stack[-1][1] if stack else OPEN
            out.append((kind, next((t for t, _ in reversed(stack) if t in BLOCKS), ""), text))

    at = 0
    while at < len(page):
        found = _TAG.search(page, at)
        upto = found.start() if found else len(page)
        if upto > at:
            pieces.append(references.unescape(page[at:upto]))
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:  # an end tag closes what is open up to its element
            if tag in BLOCKS:
                end_block()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                if any(stack[k][1] != stack[depth][1] for k in range(depth, len(stack))) or tag not in BLOCKS and depth and stack[depth][1] != stack[depth - 1][1]:
                    end_block()
                del stack[depth:]
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            end_block()
            while stack and stack[-1][0] == "p":
                stack.pop()
            ends = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in LISTS:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    break
        attributes = found[3] or found[6] or ""
        if tag in VOID:
            continue
        outer = stack[-1][1] if stack else OPEN
        if tag in BLOCKS:
            stack.append((tag, _kind_of(tag, attributes, outer)))
        elif "=" in attributes:
            kind = _kind_of(tag, attributes, outer)
            if kind != outer:
                end_block()
                stack.append((tag, kind))
    end_block()
    return out


def window_ranks(stream: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the `length` tokens from each place on, and whether they end before their page (a negative token) does.

    Suffixes are ranked by their first 1, 2, 4, ... tokens.
    """
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < length:
        step = min(done, length - done)
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + behind, return_inverse=True)[1].astype(np.int64)
        done += step
    ends = np.flatnonzero(stream < 0)
    fits = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) >= length
    return rank, fits


def page_counts(stream: np.ndarray, page: np.ndarray, length: int) -> np.ndarray:
    """For each place the number of distinct pages in which the `length` tokens from there on occur; none where the page ends before."""
    rank, fits = window_ranks(stream, length)
    return np.where(fits, _pages_of_ranks(rank, page)[rank], 0).astype(np.int64)


def _pages_of_ranks(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each rank the number of distinct pages that have it."""
    n = len(rank)
    order = np.lexsort((page, rank))  # the suffix array, equal beginnings by page
    r, p = rank[order], page[order]
    first = np.ones(n, bool)
    first[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    return np.bincount(r, weights=first, minlength=n).astype(np.int64)


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Places that lie in a window of `length` from one of the marked places."""
    steps = np.zeros(len(starts) + length, np.int64)
    steps[: len(starts)] += starts
    steps[length:] -= starts
    return np.cumsum(steps)[: len(starts)] > 0


class Numbers(dict):
    """Numbers of tokens, in the order in which they are first asked for."""

    def __missing__(self, token: str) -> int:
        value = self[token] = len(self)
        return value


def main_texts(pages: list[str], length: int = MIN_TOKENS, listed: list[tuple[str, bool]] | None = None) -> list[str]:
    """The main text of each of the pages of one group.

    `listed`, if given, are the windows on enough pages of the host to count among open blocks,
    and whether they are on enough to count in main parts; else the pages are the host.
    """
    numbers, same = Numbers(), {}
    read, marks, firsts, parts, owners = [], [], [], [], []
    at = 0
    for page in pages:
        blocks = blocks_of(page)
        tokens = [f"<{tag}> {text}".split(" ") for _, tag, text in blocks]
        sizes = [len(t) for t in tokens]
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(tokens)), np.int64, sum(sizes))
        mark = same.setdefault(flat.tobytes(), len(same))  # pages with the same stream count once
        if mark == len(firsts):
            firsts.append(at)
            parts += [flat, np.array([-1 - mark], np.int64)]
            owners.append(np.full(len(flat) + 1, mark, np.int64))
            at += len(flat) + 1
        read.append((blocks, sizes))
        marks.append(mark)
    if listed is None:
        counts = page_counts(np.concatenate(parts), np.concatenate(owners), length)
        enough = lambda share, least: counts >= max(least, -(-len(same) // share))
        often, most = _covered(enough(OPEN_SHARE, OPEN_PAGES), length), _covered(enough(MAIN_SHARE, MAIN_PAGES), length)
    else:  # the windows stand behind the pages, and get the ranks of their places
        for k, (window, _) in enumerate(listed):
            parts += [np.array([numbers[t] for t in window.split(" ")], np.int64), np.array([-1 - len(same) - k], np.int64)]
        rank, fits = window_ranks(np.concatenate(parts), length)
        ranks, main = rank[at + np.arange(len(listed)) * (length + 1)], np.array([m for _, m in listed], bool)
        often, most = (_covered(fits & np.isin(rank, r), length) for r in (ranks, ranks[main]))
    return ["\n\n".join(_kept(blocks, sizes, often[firsts[mark] :], most[firsts[mark] :])) for (blocks, sizes), mark in zip(read, marks)]


def _kept(blocks: list[tuple[int, str, str]], sizes: list[int], often: np.ndarray, most: np.ndarray) -> list[str]:
    """The texts of the blocks that stay; `sizes` counts each block's tokens, its mark first."""
    best = max((kind for kind, _, _ in blocks), default=FURNITURE)
    if best == FURNITURE:
        return []
    covers = often if best == OPEN else most
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    chosen = [k for k, (kind, _, _) in enumerate(blocks) if kind == best]
    words = {k: covers[starts[k] + 1 : starts[k + 1]] for k in chosen}
    inside = {k: bool(words[k].all()) for k in chosen} if covers[: starts[-1]].any() else {}
    if best != OPEN and any(inside.values()) and COPY_SHARE * sum(int(w.sum()) for w in words.values()) >= sum(len(w) for w in words.values()):
        inside = {}
    return [blocks[k][2] for k in chosen if not inside.get(k)] or [blocks[k][2] for k in chosen]


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty for null and relative ones."""
    place = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)", 1)
    return F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":\d*$", "")


def _joined(streams: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The tokens of the streams, each stream ended by a mark of its own: as text, as numbers, and whose they are."""
    numbers, words, parts, owners = Numbers(), [], [], []
    for k, stream in enumerate(streams):
        tokens = stream.split(" ") if stream else []
        words += [*tokens, ""]
        parts += [np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)), np.array([-1 - k], np.int64)]
        owners.append(np.full(len(tokens) + 1, k, np.int64))
    return words, np.concatenate(parts), np.concatenate(owners)


def frequent_windows(streams: list[str], length: int = MIN_TOKENS) -> list[str]:
    """The windows on enough of these different streams that they may be on a quarter of the host's."""
    words, stream, owner = _joined(streams)
    rank, fits = window_ranks(stream, length)
    places = np.flatnonzero(fits & (_pages_of_ranks(rank, owner)[rank] >= -(-len(streams) // OPEN_SHARE)))
    firsts = places[np.unique(rank[places], return_index=True)[1]]
    return [" ".join(words[i : i + length]) for i in firsts.tolist()]


def counts_of_windows(streams: list[str], windows: list[str], length: int = MIN_TOKENS) -> list[int]:
    """On how many of these different streams each window is."""
    _, stream, owner = _joined(streams + windows)
    rank, _ = window_ranks(stream, length)
    own = owner < len(streams)
    starts = int(own.sum()) + np.arange(len(windows)) * (length + 1)
    # each rank of a window once more than on the streams: by the window itself
    return (_pages_of_ranks(rank, np.where(own, owner, len(streams)))[rank[starts]] - 1).tolist()


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, parts, stream): the token streams of pages, equal ones of a host once a task."""
    seen = set()
    for batch in batches:
        rows = []
        for host, parts, page in zip(*(batch.column(c).to_pylist() for c in ("host", "parts", "html"))):
            stream = " ".join(f"<{tag}> {text}" for _, tag, text in blocks_of(page))
            mark = hashlib.sha256(f"{stream}\n{host}".encode()).digest()  # a stream has no line end
            if mark not in seen:
                seen.add(mark)
                rows.append((host, parts, stream))
        names = {"host": pa.string(), "parts": pa.int64(), "stream": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(names.values())], names=list(names))


def host_windows(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(host, part, window, main): for every part of the hosts in `hot` the windows that count on the whole host, and one row without a window."""
    read = rows.join(hot, "host").select("host", "parts", "html").mapInArrow(_streams, "host string, parts long, stream string")
    streams = stored(read.select("host", F.pmod(F.xxhash64("stream"), F.col("parts")).alias("part"), "stream"))

    def frequent(key: tuple, table: pa.Table) -> pa.Table:
        some = table.column("stream").unique().to_pylist()
        windows = [None, *frequent_windows(some)]
        return pa.table({"host": pa.array([key[0].as_py()] * len(windows), pa.string()), "n": pa.array([len(some)] * len(windows), pa.int64()), "window": pa.array(windows, pa.string())})

    found = stored(streams.groupBy("host", "part").applyInArrow(frequent, "host string, n long, window string"))
    totals = found.where("window IS NULL").groupBy("host").agg(F.sum("n").alias("total"))
    parts = hot.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    wanted = parts.join(found.where("window IS NOT NULL").select("host", "window").distinct(), "host")

    def counted(key: tuple, table: pa.Table, windows: pa.Table) -> pa.Table:
        some, asked = table.column("stream").unique().to_pylist(), windows.column("window").to_pylist()
        counts = counts_of_windows(some, asked) if some and asked else [0] * len(asked)
        return pa.table({"host": windows.column("host"), "window": windows.column("window"), "n": pa.array(counts, pa.int64())})

    counts = streams.groupBy("host", "part").cogroup(wanted.groupBy("host", "part")).applyInArrow(counted, "host string, window string, n long")
    sums = counts.groupBy("host", "window").agg(F.sum("n").alias("n")).join(totals, "host")
    enough = lambda share, least: F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("total") / share))
    listed = sums.where(enough(OPEN_SHARE, OPEN_PAGES)).select("host", "window", enough(MAIN_SHARE, MAIN_PAGES).alias("main"))
    none = parts.select("host", "part", F.lit(None).cast("string").alias("window"), F.lit(False).alias("main"))
    return none.unionByName(parts.join(listed, "host"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page, its blocks joined by an empty line."""
    name = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html").cast("long")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / GROUP_PAGES), F.ceil(F.col("bytes") / GROUP_BYTES))
    hot = sizes.select("host", parts.alias("parts")).where("parts > 1")
    several = stored(hot)
    hosts = several.agg(F.count(F.lit(1)), F.count(F.when(F.col("host") != "", 1))).first()
    hot = F.broadcast(several) if hosts[0] <= HOT_HOSTS else several
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part")
    # a host that isn't known is no host: such pages are spread, and read one by one
    dealt = rows.join(hot, "host", "left").select("host", part, "page_id", "url", "html")

    def texts_of(key: tuple, table: pa.Table, listed: list[tuple[str, bool]] | None = None) -> pa.Table:
        texts = table.column("html").to_pylist()
        found = [main_texts([t])[0] for t in texts] if key[0].as_py() == "" else main_texts(texts, listed=listed) if texts else []
        return pa.table([table.column("page_id"), table.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    def group(key: tuple, table: pa.Table) -> pa.Table:
        return texts_of(key, table)

    def part_of_host(key: tuple, table: pa.Table, windows: pa.Table) -> pa.Table:
        listed = [(w, m) for w, m in zip(windows.column("window").to_pylist(), windows.column("main").to_pylist()) if w is not None]
        return texts_of(key, table, listed if windows.num_rows else None)

    schema = f"page_id {name}, url string, text string"
    if not hosts[1]:
        return dealt.groupBy("host", "part").applyInArrow(group, schema)
    named = several.where(F.col("host") != "")
    windows = host_windows(rows, F.broadcast(named) if hosts[0] <= HOT_HOSTS else named)
    return dealt.groupBy("host", "part").cogroup(windows.groupBy("host", "part")).applyInArrow(part_of_host, schema)
