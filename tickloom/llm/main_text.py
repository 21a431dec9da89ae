"""Main text of web pages: markup rules, and a suffix array over each host's pages.

A page becomes blocks in page order.  Text inside <article> or <main> is content,
text inside navigation, headers, footers, asides, forms, scripts and styles, or inside
elements whose class, id or role names such a part, is not.  A form, or an element named
for its layout ("page-with-sidebar"), may wrap the whole page: a main inside it is content, and an
article is where no content has fewer such wrappers around it.  What is in neither is
undecided: for the pages of a host, these blocks and the blocks that markup leaves out
are one stream of words per page; a suffix array over the streams of a shard finds
runs of at least RUN words that also stand in another page, and an undecided block keeps
the words that no such run covers.  Boilerplate without telling markup goes that way,
and text that stands on one page stays.  Content is not searched: copies of an article,
and passages that articles share, are text.

A host's pages are dealt by hash into shards of about SHARD_PAGES, so a host of any
size is many tasks.  Where a host has several, each shard also lists its runs by a
128-bit hash, and a run that two shards list stands in two pages: it is removed too, so
the result does not depend on the size of the host.

Null html: empty text.  Null or odd url: the pages of the empty host.  Repeated rows are
one page for the search, and each a row of the result.  Broken markup: tags that are
never closed end with their parent.  Pages without article or main: everything that is
neither marked nor repeated.  Empty table: no rows.  Other columns are not touched."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.fm_index import suffix_order
from tickloom.llm.shared import bit_of, bits_at, key_bits, small_batches, stored

RUN = 6
SHARD_PAGES = 500
MIX = np.uint64(0x9E3779B97F4A7C15)
CONTENT, LEFT_OUT, UNDECIDED = 0, 1, 2
WRAPPER, BARRED = 1, 2

# HTML's element kinds, and customary names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select option datalist canvas audio video".split())
OUTSIDE = frozenset("nav header footer aside form button menu dialog fieldset label head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
NAMES = ("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar side aside widget notice notices cookie cookies "
         "consent gdpr banner alert ad ads advert adverts advertisement advertising promo promotion sponsor sponsored "
         "newsletter subscribe subscription signup popup modal overlay share sharing social related recommended comment "
         "comments commentlist replies reply respond disqus login search paywall skip toolbar pagination pager").split()
HEADERS = ["header", "masthead", "topbar"]
ALL_NAMES = frozenset(NAMES + HEADERS)
ITEMS = frozenset("comment reply teaser ad advert promo sponsored related".split())
ABOUT = ("has-", "with-", "no-", "is-")
#: Parts that layout containers are named after, too, as "content-sidebar-wrap".
LAYOUT = frozenset("nav navbar navigation menu sidebar side aside header masthead topbar footer banner toolbar".split())
PARTS, PARTS_IN_CONTENT = (re.compile(rf"(?:^|[_-])(?:{'|'.join(n)})(?:$|[_-])") for n in (NAMES + HEADERS, NAMES))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that say how a part is laid out, and not what it holds.
GENERIC = frozenset("area bar block box button buttons cell col column container content form group holder icon icons inner "
                    "item items link links list main outer page panel post posts row section site slot stories text title "
                    "top bottom left right unit user wrap wrapper".split())
#: A quote opens a value only after "="; any other one is a character of the tag.  No part
#: gives back what it has taken, so broken tags cost linear time.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
                   r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


def _unwanted(name: str, attributes: str, in_content: bool) -> int:
    """0: not left out; WRAPPER: left out, but may hold the page's article or main; BARRED."""
    if name in OUTSIDE and not (in_content and name == "header") and (in_content or name != "form"):
        return BARRED
    if name in ("html", "body"):
        return 0
    out = WRAPPER if name == "form" else 0
    parts = PARTS_IN_CONTENT if in_content else PARTS
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            for one in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
                # an article or main element is only what its whole name says
                if name in ("article", "main"):
                    if one in ITEMS:
                        return BARRED
                elif parts.search(one) and not one.startswith(ABOUT):
                    words = set(re.split("[_-]", one))
                    named = ALL_NAMES & words
                    if in_content:
                        # "share-price" and "side-by-side" are content, "share-box" is not
                        if all(w in ALL_NAMES or w in GENERIC or not w.isalpha() for w in words):
                            return BARRED
                    elif one in named or not named <= LAYOUT:
                        return BARRED
                    else:
                        out = WRAPPER
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return BARRED
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return BARRED
    return out


def _inside(name: str, attributes: str, kind: int) -> int:
    """The kind of text in an element that opens in text of a kind.  Inside n wrappers
    that is 2 n + 1, or 2 n + 2 in an article there."""
    if kind == LEFT_OUT:
        return kind
    in_content = kind != UNDECIDED and kind % 2 == 0
    unwanted = _unwanted(name, attributes, in_content)
    if unwanted == BARRED:
        return LEFT_OUT
    if in_content:
        return kind
    wrappers = 0 if kind == UNDECIDED else kind // 2
    if unwanted == WRAPPER:
        return 2 * wrappers + 3
    if name == "main" or name == "article" and not wrappers:
        return CONTENT
    return kind + 1 if name == "article" else kind


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block with text, in page order; references are decoded and
    white space is one space."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, and the kind of text inside
    opened: Counter[str] = Counter()  # how many of a name are on the stack
    kind, at, skip = UNDECIDED, 0, ""

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            out.append((kind, text))

    for token in TOKEN.finditer(page):
        if token.start() < at:
            continue
        if token.start() > at:
            pieces.append(page[at:token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            if token[0].startswith("<![CDATA["):
                pieces.append(token[0][9:-3])
            continue
        if name not in INLINE:
            close()
        if token[1]:
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    if name in INLINE and stack[i][1] != kind:
                        close()
                    opened.subtract(n for n, _ in stack[i:])
                    del stack[i:]
                    kind = stack[-1][1] if stack else UNDECIDED
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break  # an inline end does not close the blocks inside it
            continue
        if name in VOID or token[3].endswith("/") and name not in OUTSIDE:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        inside = _inside(name, token[3], kind)
        if inside != kind:
            close()
        stack.append((name, inside))
        opened[name] += 1
        kind = inside
    if at < len(page):
        pieces.append(page[at:])
    close()
    best = min((k for k, _ in out if k != UNDECIDED and k % 2 == 0), default=CONTENT)
    return [(CONTENT if k in (CONTENT, best) else UNDECIDED if k == UNDECIDED else LEFT_OUT, t) for k, t in out]


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Which tokens of the concatenated streams stand in a run of at least `run` tokens
    that another page holds too.  Streams end with tokens of their own."""
    n = len(tokens)
    cover = np.zeros(n + 1, np.int64)
    if n <= run:
        return np.zeros(n, bool)
    order = suffix_order(tokens, run)
    same = np.ones(n - 1, bool)  # do neighbours in the order agree in their first `run` tokens
    for i in range(run):
        x, y = order[:-1] + i, order[1:] + i
        inside = (x < n) & (y < n)
        same &= inside & (tokens[np.minimum(x, n - 1)] == tokens[np.minimum(y, n - 1)])
    group = np.concatenate(([0], np.cumsum(~same)))
    low = np.full(group[-1] + 1, n, np.int64)
    high = np.full(group[-1] + 1, -1, np.int64)
    np.minimum.at(low, group, page[order])
    np.maximum.at(high, group, page[order])
    hit = order[(low != high)[group]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, np.minimum(hit + run, n), -1)
    return np.cumsum(cover)[:-1] > 0


def _stream(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of a shard in page order, their words, how many each has, the words'
    codes and pages, and the distinct words."""
    frame = frame.drop_duplicates(["page_key", "at"]).sort_values(["page_key", "at"], ignore_index=True)
    words = [t.split() for t in frame["text"]]
    lengths = np.array([len(w) for w in words])
    page = np.repeat(pd.factorize(frame["page_key"])[0], lengths)
    codes, kinds = pd.factorize(np.array([x for w in words for x in w], object))
    return frame, words, lengths, codes.astype(np.int64), page, kinds


def run_hashes(codes: np.ndarray, page: np.ndarray, kinds: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of `run` words inside one page start, and a 128-bit hash of each, by words."""
    start = np.flatnonzero(page[:len(page) - run + 1] == page[run - 1:]) if len(page) >= run else np.zeros(0, np.int64)
    out = np.zeros((len(start), 2), np.uint64)
    for half, key in enumerate(("tickloom-runs-00", "tickloom-runs-01")):
        values = pd.util.hash_array(kinds, hash_key=key, categorize=False)[codes] if len(start) else codes.astype(np.uint64)
        for i in range(run):
            out[:, half] = out[:, half] * MIX ^ values[start + i]
            out[:, half] ^= out[:, half] >> np.uint64(29)
    return start, out.view(np.int64)


def _shard_runs(frame: pd.DataFrame, run: int) -> pd.DataFrame:
    """(host, shard, a, b): the hash of each distinct run of a shard."""
    host, shard = frame["host"].iloc[0], frame["shard"].iloc[0]
    _, _, _, codes, page, kinds = _stream(frame)
    out = pd.DataFrame(run_hashes(codes, page, kinds, run)[1], columns=["a", "b"]).drop_duplicates(ignore_index=True)
    return out.assign(host=host, shard=shard)[["host", "shard", "a", "b"]]


def _kept_runs(frame: pd.DataFrame, run: int, elsewhere: pd.DataFrame | None = None) -> pd.DataFrame:
    """(page_key, at, text): what is left of the undecided blocks of a shard's pages, given
    its runs that other shards hold."""
    if not len(frame):
        return pd.DataFrame([], columns=["page_key", "at", "text"])
    frame, words, lengths, codes, page, kinds = _stream(frame)
    # a token of its own after each page, so that no run crosses pages
    last = np.append(page[1:] != page[:-1], True)
    slot = np.arange(len(codes)) + np.concatenate(([0], np.cumsum(last)[:-1]))
    tokens = np.empty(len(codes) + int(last.sum()), np.int64)
    pages = np.empty(len(tokens), np.int64)
    tokens[slot], pages[slot] = codes, page
    ends = slot[last] + 1
    tokens[ends], pages[ends] = len(codes) + np.arange(len(ends)), page[last]
    gone = repeated_tokens(tokens, pages, run)[slot]
    if elsewhere is not None and len(elsewhere):
        start, hashes = run_hashes(codes, page, kinds, run)
        met = pd.MultiIndex.from_arrays(hashes.T).isin(pd.MultiIndex.from_frame(elsewhere[["a", "b"]]))
        for i in range(run):
            gone[start[met] + i] = True
    starts = np.concatenate(([0], np.cumsum(lengths)))
    rows = []
    for i in np.flatnonzero((frame["kind"] == UNDECIDED).to_numpy()):
        left = [w for w, g in zip(words[i], gone[starts[i]:starts[i + 1]]) if not g]
        if left:
            rows.append((frame["page_key"][i], frame["at"][i], " ".join(left)))
    return pd.DataFrame(rows, columns=["page_key", "at", "text"])


def _keyed(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html",
                        F.xxhash64("page_id", "url", "html").alias("page_key"), host.alias("host"))


def parse(pages: DataFrame, bits: bytes | None = None, present: bool = True) -> DataFrame:
    """page_id, url, page_key, host and the blocks (at, kind, text) of every page; with a
    key map, of the pages that are in it, or that are not."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(bits_at(bits, batch.column("bit")) == present))
            for at in range(0, batch.num_rows, 100):
                rows = batch.slice(at, 100)
                found = [[{"at": i, "kind": k, "text": t} for i, (k, t) in enumerate(blocks(p.as_py() or ""))]
                         for p in rows.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("page_id", "url", "page_key", "host")), pa.array(found, kind)],
                    ["page_id", "url", "page_key", "host", "blocks"])

    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return _keyed(pages).withColumn("bit", bit_of("page_key")).mapInArrow(
        work, f"page_id {kind}, url string, page_key long, host string, blocks array<struct<at:int,kind:int,text:string>>")


def extract(pages: DataFrame, run: int = RUN, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Only the words outside the content are shuffled, and the pages that get some of
    them back; the others are parsed where they are read."""
    sizes = _keyed(pages).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    around = parse(pages).select("host", "page_key", F.filter("blocks", lambda b: b["kind"] != CONTENT).alias("blocks"))
    streams = (around.filter(F.size("blocks") > 0).join(sizes, "host")
               .withColumn("shard", F.pmod(F.xxhash64("page_key"), F.ceil(F.col("pages") / shard_pages)))
               .select("host", "shard", "page_key", (F.col("pages") > shard_pages).alias("large"), F.explode("blocks").alias("b"))
               .select("host", "shard", "page_key", "large", "b.*"))
    left = "page_key long, at int, text string"
    if sizes.filter(F.col("pages") > shard_pages).isEmpty():
        rest = streams.drop("large").repartition("host", "shard").groupBy("host", "shard").applyInPandas(
            lambda frame: _kept_runs(frame, run), left)
    else:
        # read again, so that what follows is dealt by host and shard and not by the host alone
        streams = stored(streams)
        runs = stored(streams.filter("large").drop("large").groupBy("host", "shard").applyInPandas(
            lambda frame: _shard_runs(frame, run), "host string, shard long, a long, b long"))
        # one row per shard that holds a run, however many pages of it do
        several = runs.groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("shards")).filter("shards > 1")
        elsewhere = runs.join(several.drop("shards"), ["host", "a", "b"])
        rest = streams.drop("large").groupBy("host", "shard").cogroup(elsewhere.groupBy("host", "shard")).applyInPandas(
            lambda frame, other: _kept_runs(frame, run, other), left)
    kept = stored(rest.groupBy("page_key").agg(F.collect_list(F.struct("at", "text")).alias("more")))
    bits = key_bits(kept, "page_key")
    none = F.lit(None).cast("array<struct<at:int,text:string>>")
    rows = parse(pages, bits).join(kept, "page_key", "left").select("page_id", "url", "blocks", "more").unionAll(
        parse(pages, bits, False).select("page_id", "url", "blocks", none.alias("more")))
    content = F.transform(F.filter("blocks", lambda b: b["kind"] == CONTENT),
                          lambda b: F.struct(b["at"].alias("at"), b["text"].alias("text")))
    parts = F.array_sort(F.concat(content, F.coalesce("more", F.array().cast("array<struct<at:int,text:string>>"))))
    text = F.array_join(F.transform(parts, lambda b: b["text"]), " ")
    return rows.withColumn("text", text).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
