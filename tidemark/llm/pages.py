"""Main text of web pages: a suffix array over the pages of each host, checked by the structure of the page.

A page is cut into blocks in page order. Blocks in menus, headers, footers, forms and the like are dropped. If a
page has a main container (article, main, ...), its stream of tokens is that of the blocks inside it, else that of all
blocks that are left. The streams of a host's pages go into one suffix array with common prefixes; suffixes that share
LEAST_TOKENS tokens with a suffix of another page are the repeated strings. They are the boilerplate of pages without
a container, also where the other page has one and the string stands beside it, and the unique runs between them stay.
Inside a container the check follows: what the page itself marks
as its article stays, repeated or not, and the repeated blocks are counted.

A host of up to HOST_CHARS characters is sorted in one task. The suffixes of a larger one are dealt over the tasks by
their first LEAST_TOKENS tokens, which is its suffix array sorted to that depth, so the size of a host changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import groups_of, stored, table, whole_text

#: Elements without text of their own, and those that break the line.
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist textarea button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements an opening tag closes by itself.
CLOSES = {"p": BLOCK - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
ASIDE = frozenset("nav header footer aside form menu dialog search fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog tablist toolbar".split())
#: Words of class and id that name what is not the article.
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "outbrain pager pagination paywall popup promo promoted promotion recommended related reply replies respond share sharing sidebar signin signup sitemap skyscraper social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
MAIN_NAMES = frozenset("article articlebody content entry main maincontent post postbody postcontent story storybody".split())
#: A quote counts only after an equals sign, and attributes are taken without going back. Behind the last ">" of a
#: page no tag can end, so none is looked for there: a page is read in one pass.
MARKUP, TEXT = r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?", r"<[a-zA-Z/][^<>]*$|[^<]+|<"
TAG = r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
TOKEN, LAST_TOKENS = re.compile(f"{MARKUP}|{TAG}|{TEXT}", re.S), re.compile(f"{MARKUP}|{TEXT}", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title", "iframe", "noscript")}
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Tokens a repeated string needs, and what the border of two blocks counts for: a block of four words that stands
#: alone on two pages is such a string, a phrase inside two paragraphs needs eight words.
LEAST_TOKENS, BORDER = 8, ("", "")
#: Characters of html of a host that one task sorts: some 1.3 million tokens in arrays of 8 bytes.
HOST_CHARS = 8_000_000
ASIDE_STATE, MAIN_STATE, OPEN_STATE = 0, 1, 2


def states_of(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is apart from the article, and whether it is its container."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag in ASIDE, tag in ("article", "main")
    values = {name.lower(): value.strip("\"'") for name, value in ATTRIBUTE.findall(attributes)}
    role = values.get("role", "").lower()
    names = {p.lower() for p in NAME_PARTS.findall(f"{values.get('class', '')} {values.get('id', '')}")}
    whole = {w.lower() for w in re.split(r"[\s_]+", f"{values.get('class', '')} {values.get('id', '')}") if w}
    unseen = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I)
    main = tag in ("article", "main") or role in ("main", "article") or values.get("itemprop", "").lower() == "articlebody"
    named_main = bool({w.replace("-", "") for w in whole} & MAIN_NAMES)
    apart = tag in ASIDE or role in ASIDE_ROLES or bool(unseen) or bool(names & ASIDE_NAMES) and tag not in ("html", "body", "main", "h1", "h2", "h3")
    return apart, main or named_main and not apart


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, state) of each block in page order; character references decoded, white space made one space."""
    stack: list[tuple[str, int, bool, int]] = []  # tag, state inside, hidden inside, number of its container
    state, hidden, container, containers = OPEN_STATE, False, 0, 0
    held: list[str] = []
    out: list[tuple[str, int, int]] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, state, container))

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        m = (TOKEN if at <= last else LAST_TOKENS).match(page, at)
        tag = m.group(2) if at <= last else None
        at = m.end()
        if tag is None:
            text = m.group(0)
            if not hidden and not text.startswith(("<!", "<?")) and (text == "<" or not text.startswith("<")):
                held.append(unescape(text))
            continue
        tag = tag.lower()
        if m.group(1):
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag in BLOCK:
                flush()
            if depth >= 0:
                if any(t in BLOCK for t, *_ in stack[depth:]):
                    flush()
                del stack[depth:]
                _, state, hidden, container = stack[-1] if stack else ("", OPEN_STATE, False, 0)
            continue
        if tag in BLOCK:
            flush()
        while stack and tag in CLOSES.get(stack[-1][0], ()):
            stack.pop()
            _, state, hidden, container = stack[-1] if stack else ("", OPEN_STATE, False, 0)
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK:
            continue
        apart, main = states_of(tag, m.group(3))
        if apart and state != ASIDE_STATE and not (state == MAIN_STATE and tag == "header"):
            flush()
            state = ASIDE_STATE
        elif main and state != ASIDE_STATE:
            flush()
            if state != MAIN_STATE:
                containers += 1
                container = containers
            state = MAIN_STATE
        hidden = hidden or tag in HIDDEN
        stack.append((tag, state, hidden, container))
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.start() if end else size
    flush()
    return [(text, s) for text, s, _ in out]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and how many tokens each shares with the suffix before it.

    Prefix doubling: a round sorts the suffixes that still tie by the rank of what follows, so unique ones are left
    alone. The ranks of each round are kept; the common prefixes are put together from them, the widest first.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    first = np.ones(n, bool)  # no tie with the suffix before
    first[1:] = tokens[order[1:]] != tokens[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rounds, width = [], 1
    while True:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(tied):
            break
        rounds.append((width, rank.copy()))
        held = order[tied]
        after = np.where(held + width < n, rank[np.minimum(held + width, n - 1)], -1)
        key = rank[held].astype(np.int64) * (n + 1) + after + 1
        by_key = np.argsort(key, kind="stable")
        held, key = held[by_key], key[by_key]
        order[tied] = held
        first[tied[1:]] |= key[1:] != key[:-1]
        rank[held] = np.maximum.accumulate(np.where(first[tied], tied, 0))
        width *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for width, ranks in reversed(rounds):
        same = np.flatnonzero((a < n) & (b < n))
        same = same[ranks[a[same]] == ranks[b[same]]]
        common[1 + same] += width
        a[same] += width
        b[same] += width
    return order, common


def shared_starts(order: np.ndarray, common: np.ndarray, pages: np.ndarray, least: int, counted: np.ndarray | None = None) -> np.ndarray:
    """By place: whether the suffix there shares `least` tokens with one of another page; only counted places count."""
    found = np.zeros(len(order), bool)
    if not len(order):
        return found
    begins = np.flatnonzero(np.append(True, common[1:] < least))
    counts = np.ones(len(order), bool) if counted is None else counted[order]
    page = pages[order]
    lowest = np.minimum.reduceat(np.where(counts, page, np.iinfo(page.dtype).max), begins)
    highest = np.maximum.reduceat(np.where(counts, page, -1), begins)
    found[order] = counts & np.repeat((highest >= 0) & (lowest < highest), np.diff(np.append(begins, len(order))))
    return found


def covered_by(starts: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in the `least` tokens behind a start; longer strings are chains of such starts."""
    mark = np.zeros(len(starts) + least + 1, np.int64)
    mark[: len(starts)] += starts
    mark[least : least + len(starts)] -= starts
    return np.cumsum(mark)[: len(starts)] > 0


def repeated(tokens: np.ndarray, pages: np.ndarray, least: int = LEAST_TOKENS) -> np.ndarray:
    """Which tokens are covered by a string of `least` or more tokens that stands on two pages or more.

    `tokens` holds a separator of its own (negative, all different) after each page.
    """
    order, common = suffix_array(tokens)
    return covered_by(shared_starts(order, common, pages, least), least)


def wanted(blocks: list[tuple[str, int]]) -> tuple[list[str], bool]:
    """The blocks that may be main text, and whether a container of the page says that they are."""
    inside = any(s == MAIN_STATE for _, s in blocks)
    return [text for text, s in blocks if s == (MAIN_STATE if inside else OPEN_STATE)], inside


def beside(blocks: list[tuple[str, int]]) -> list[str]:
    """The open blocks of a page with a container, which stand outside it: no article text, so boilerplate elsewhere too."""
    return [text for text, s in blocks if s == OPEN_STATE] if any(s == MAIN_STATE for _, s in blocks) else []


def stream_of(texts: list[str]) -> list[str]:
    """Tokens of a page's open blocks, with borders before, between and behind them."""
    tokens = list(BORDER)
    for text in texts:
        tokens += text.split(" ")
        tokens += BORDER
    return tokens


def block_starts(texts: list[str]) -> list[int]:
    """Where the border before each block stands in the stream."""
    return np.cumsum([0, *[len(BORDER) + text.count(" ") + 1 for text in texts]])[:-1].tolist()


def host_texts(pages: list[tuple[list[str], bool]], least: int = LEAST_TOKENS, outside: list[list[str]] = ()) -> list[tuple[str, int]]:
    """(text, repeated blocks) of each page of one host, given its blocks and whether they are a container's.

    Equal pages count as one. A string on two pages without a container goes there, and so does one that also stands
    in `outside`, the blocks beside the containers of other pages. These give no text and no repeated blocks.
    """
    numbers: dict[tuple, int] = {}
    ids: dict[str, int] = {}
    number = [numbers.setdefault((inside, *texts), len(numbers)) for texts, inside in pages]
    streams = [stream_of(list(texts)) for _, *texts in numbers] + [stream_of(list(texts)) for texts in {tuple(t): None for t in outside if t}]
    ends = np.cumsum([len(s) + 1 for s in streams])
    tokens = np.empty(ends[-1] if len(ends) else 0, np.int64)
    for k, (end, stream) in enumerate(zip(ends, streams)):
        tokens[end - 1 - len(stream) : end - 1] = [ids.setdefault(t, len(ids)) for t in stream]
        tokens[end - 1] = -1 - k
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    apart = owner >= len(numbers)
    is_open = np.array([not inside for inside, *_ in numbers] + [False] * (len(streams) - len(numbers)), bool)[owner]
    order, common = suffix_array(tokens)
    anywhere = shared_starts(order, common, owner, least, ~apart)
    gone = covered_by(shared_starts(order, common, owner, least, is_open | apart), least) & is_open
    out = []
    for end, stream, (_, *texts) in zip(ends, streams, numbers):
        begin = end - 1 - len(stream)
        text = " ".join([t for t, g in zip(stream, gone[begin : end - 1].tolist()) if t and not g])
        out.append((text, int(anywhere[begin + np.array(block_starts(texts), np.int64)].sum())))
    return [out[k] for k in number]


def digest_of(parts: list[str]) -> int:
    """A digest of strings without line breaks."""
    return int.from_bytes(blake2b("\n".join(parts).encode(), digest_size=8).digest(), "big", signed=True)


def suffix_keys(tokens: list[str], least: int = LEAST_TOKENS, places: list[int] | None = None) -> list[int]:
    """A digest of the first `least` tokens of each suffix that has so many, by place, or of those at some places."""
    chosen = range(len(tokens) - least + 1) if places is None else [i for i in places if i + least <= len(tokens)]
    return [digest_of(tokens[i : i + least]) for i in chosen]


def unique_runs(texts: list[str], common: set[int], least: int = LEAST_TOKENS) -> str:
    """The tokens no common suffix start covers, block by block."""
    tokens = stream_of(texts)
    until, kept = 0, []
    keys = suffix_keys(tokens, least)
    for i, token in enumerate(tokens):
        if i < len(keys) and keys[i] in common:
            until = i + least
        if i >= until and token:
            kept.append(token)
    return " ".join(kept)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, host_chars: int = HOST_CHARS) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars, repeated_blocks.

    Needs page_id, url and html; other columns are not read. A null html is empty and its text too; pages with
    a null or odd url share one host. Every page of a host of up to `host_chars` characters goes to the host's suffix
    array in one task. Of larger hosts the suffixes are counted by host and first tokens, as narrow rows with
    partial sums, so a phrase on every page of a large host is one row a task; their pages with a container, whose
    tokens all stay, give the suffixes at block starts and those of the blocks beside the container. Pages of a host with equal blocks, under
    one url or several, count as one page and get equal texts; a page without container whose strings are all on other
    such pages is left empty. A very long page is a long list of digests in its own row and nothing more.
    repeated_blocks counts the page's blocks that begin with a string (LEAST_TOKENS tokens with the border before the
    block) that stands on another page of the host.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed_fields = f"page_id {kind}, url string, host string, inside boolean, blocks array<string>, outside array<string>, body bigint"
    settled_fields = f"page_id {kind}, url string, text string, repeated_blocks bigint"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [blocks_of(html) for html in batch.column("html").to_pylist()]
            found = [wanted(blocks) for blocks in cut]
            bodies = [digest_of([str(inside), *texts]) for texts, inside in found]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("page_id", "url", "host")], pa.array([i for _, i in found], pa.bool_()), pa.array([t for t, _ in found], pa.list_(pa.string())), pa.array([beside(blocks) for blocks in cut], pa.list_(pa.string())), pa.array(bodies, pa.int64())],
                ["page_id", "url", "host", "inside", "blocks", "outside", "body"],
            )

    def settled_rows(rows, found: list[tuple[str, int]]) -> pa.RecordBatch:
        held = [rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c) for c in ("page_id", "url")]
        return pa.RecordBatch.from_arrays([*held, pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["page_id", "url", "text", "repeated_blocks"])

    def settle_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["host"]):
            yield settled_rows(rows, host_texts([*zip(rows.column("blocks").to_pylist(), rows.column("inside").to_pylist())], outside=rows.column("outside").to_pylist()))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parse(batches):
            for host, body, inside, texts, apart in zip(*[batch.column(c).to_pylist() for c in ("host", "body", "inside", "blocks", "outside")]):
                keys = sorted({*suffix_keys(stream_of(texts), places=block_starts(texts) if inside else None)})
                more = sorted({*suffix_keys(stream_of(apart))}) if apart else []
                n, m = len(keys), len(more)
                open_bodies = [None if inside else body] * n + ([digest_of(["", *apart])] * m if m else [])
                yield pa.RecordBatch.from_arrays([pa.array([host] * (n + m), pa.string()), pa.array([body] * n + [None] * m, pa.int64()), pa.array(open_bodies, pa.int64()), pa.array(keys + more, pa.int64())], ["host", "body", "open_body", "start"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts, inside, common in zip(*[batch.column(c).to_pylist() for c in ("blocks", "inside", "common")]):
                gone, shared = ({c["start"] for c in common or () if c[flag]} for flag in ("goes", "seen"))
                starts = suffix_keys(stream_of(texts), places=block_starts(texts))
                text = " ".join(texts) if inside else unique_runs(texts, gone)
                found.append((text, sum(k in shared for k in starts)))
            yield settled_rows(batch, found)

    given = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), whole_text("html").alias("html"))
    # Few rows: no more than all characters over host_chars.
    large = stored(given.groupBy("host").agg(F.sum(F.char_length("html")).alias("chars")).filter(F.col("chars") > host_chars).select("host"), "hosts")
    small = given.join(F.broadcast(large), "host", "left_anti").select("page_id", "url", "host", "html").mapInArrow(parse, parsed_fields).drop("body")
    settled = small.repartition("host").sortWithinPartitions("host").mapInArrow(settle_hosts, settled_fields)
    if not large.isEmpty():
        # Parsed anew in each branch: that costs less than texts on disk between them, and each text moves once.
        rest = given.join(F.broadcast(large), "host", "left_semi").select("page_id", "url", "host", "html")
        starts = rest.mapInArrow(suffixes, "host string, body bigint, open_body bigint, start bigint")
        # Two bodies or more have a least and a largest one; these meet before the exchange.
        spans = starts.groupBy("host", "start").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("body", "open_body")])
        goes, seen = (F.coalesce(F.col(f"min_{c}") < F.col(f"max_{c}"), F.lit(False)) for c in ("open_body", "body"))
        common = spans.filter(goes | seen).select("host", "start", goes.alias("goes"), seen.alias("seen"))
        marks = starts.drop("open_body").filter("body is not null").join(common, ["host", "start"]).groupBy("host", "body").agg(F.collect_set(F.struct("start", "goes", "seen")).alias("common"))
        joined = rest.mapInArrow(parse, parsed_fields).join(marks, ["host", "body"], "left")
        settled = settled.unionByName(joined.select("page_id", "url", "inside", "blocks", "common").mapInArrow(settle, settled_fields))
    return settled.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "repeated_blocks")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
QUERIES = {"op4_html_extraction": op4_html_extraction}
