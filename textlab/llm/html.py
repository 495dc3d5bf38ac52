"""Main text of web pages: markup zones plus a suffix array of each host's text.

A page is read by a tokenizer of tags and text into blocks, each in a zone:
the article (inside ``article`` or ``main``), furniture (menus, headers, footers,
asides, forms, adverts, notices, comments, by element or by the words of its
class, id or role), or loose text (outside both).  Words that themes also give to
the wrapper of a whole page (``sidebar``, ``header``, ``nav`` and the like) do not
hold back an ``article`` inside it, and ``has-``, ``with-``, ``no-`` and ``is-`` words
say nothing about the element itself; comment, advert and sharing words do hold
back what is inside, ``article`` elements too.  A header inside an article is
furniture but for its headings: the headline is part of the main text.

Zones alone cannot tell text from furniture without telling marks.  So the
neighbouring blocks of a page, those of the article and those outside it, form
token streams, and windows of ``WINDOW`` tokens run across the edges of blocks;
a block shorter than a window counts as a whole.  The suffixes of a host's
streams are sorted by their first ``WINDOW`` tokens: in each batch by prefix
doubling (a suffix array cut off at ``WINDOW``), then across batches by the
digest of those tokens, in Spark.  What occurs on at least ``MIN_PAGES`` and at
least ``SHARE`` of the distinct pages of a host is furniture; pages of a host
with the same text outside marked furniture are one page.  Tokens it lies on
go from every page; in an article only if articles of ``MIN_PAGES`` pages hold it.

Only windows of tokens that each may reach that share can reach it themselves,
so pages are first counted by (host, hashed token), and all other windows end
where they are read.  The few that repeat are spread by (host, digest, page), so
a host with a third of all pages is spread over all tasks; what is found is
bounded by the text of two pages a host.  Windows across an edge take whole
blocks only: a sentence that begins like all others keeps its beginning.

A page is parsed once: its blocks are written to the shared folder, and the three
passes over them read that.

On a page with an article, loose text outside it is not the article's and goes
too; on other pages the loose text that is left is the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, durable, small_batches, written

#: Tokens of the shortest repeated substring that counts across the edges of blocks.
WINDOW = 10
#: Share of a host's distinct pages from which repeated text is furniture, and the least number of them.
SHARE, MIN_PAGES = 0.5, 3
#: Tokens are counted by this many hash values a host, which bounds their counts from above.
BUCKETS = 1 << 14
#: Found digests of all hosts up to this many are broadcast, so that pages need not move.
_BROADCAST = 1_000_000
ARTICLE, FURNITURE, LOOSE = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>])*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: HTML element names by what they do to the text.
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_SILENT = frozenset("head template noscript svg math object iframe canvas audio video select button datalist".split())
_ASIDE = frozenset("nav header footer aside form dialog menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_BODY = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of a class, id or role that mark furniture, and those of them that
#: the wrapper of a whole page may carry too.
_MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar widget".split())
_WRAPPER_MARKS = frozenset("banner consent cookie cookies footer gdpr header login masthead menu modal nav navbar navigation notice notices popup sidebar sidenav signup toolbar widget".split())
_MODIFIERS = ("has", "with", "without", "no", "is")
#: What an element's attributes say of it.
PLAIN, WRAPPER, MARKED = 0, 1, 2
#: Zones while a page is read: furniture that an article inside it ends, the header of an article.
_SOFT, _HEAD = 3, 4
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANKS = re.compile(r"\s+")


class Block(NamedTuple):
    zone: int
    text: str


def _judge(attributes: str) -> tuple[int, bool]:
    """Whether the attributes of a start tag mark furniture, and whether they hide the element."""
    mark, hidden = PLAIN, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                words = [w.lower() for w in _WORD.findall(token)]
                if words and words[0] not in _MODIFIERS:
                    found = _MARKS.intersection(words)
                    mark = max(mark, MARKED if found - _WRAPPER_MARKS else WRAPPER if found else PLAIN)
        elif name == "hidden" or name == "style" and _NOT_SHOWN.search(value):
            hidden = True
    return mark, hidden


_ATTRIBUTES = Memo(_judge, 20_000)


def _inner_zone(name: str, mark: int, zone: int) -> int:
    """Zone inside an element of ``name`` that lies in ``zone``."""
    if name in _BODY:
        return FURNITURE if zone == FURNITURE or mark == MARKED else ARTICLE
    if name == "header" and zone == ARTICLE:
        return _HEAD
    if name in _HEADINGS and zone == _HEAD and mark == PLAIN:
        return ARTICLE
    if name == "form" or mark == WRAPPER and name not in _ASIDE:  # these may also hold a whole page
        return _SOFT if zone in (LOOSE, _SOFT) else FURNITURE
    return FURNITURE if name in _ASIDE or mark else zone


def page_blocks(page: str) -> list[Block]:
    """Blocks of a page in order: references decoded, white space as one space, no empty ones.

    Broken markup never fails: what is left open ends with the page, an end tag
    without a start is passed over, and a block element ends the block before it.
    """
    out: list[Block] = []
    parts: list[str] = []
    open_tags: list[tuple[str, int, bool]] = []  # name, zone before it, silent before it
    zone, silent = LOOSE, False

    def close() -> None:
        if parts:
            text = _BLANKS.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(FURNITURE if zone in (_SOFT, _HEAD) else zone, text))
            parts.clear()

    def enter(new_zone: int, new_silent: bool) -> None:
        nonlocal zone, silent
        if new_zone != zone:
            close()
        zone, silent = new_zone, new_silent

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        end_mark, name, attributes, text = m.groups()
        if text is not None:
            if not silent:
                parts.append(text)
            continue
        if name is None:  # comment, doctype, processing instruction
            continue
        name = name.lower()
        if name in _BLOCK:
            close()
        if end_mark:
            depth = next((d for d in range(len(open_tags) - 1, -1, -1) if open_tags[d][0] == name), -1)
            # an inline end tag does not reach over a block that is still open
            if depth >= 0 and (name in _BLOCK or not any(t[0] in _BLOCK for t in open_tags[depth + 1:])):
                enter(*open_tags[depth][1:])
                del open_tags[depth:]
            continue
        if name == "br":
            parts.append("\n")
        if name in _VOID or attributes.rstrip().endswith("/") and name not in _BLOCK:
            continue
        if name == "p":  # a new paragraph ends an open one
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == "p":
                    enter(*open_tags[depth][1:])
                    del open_tags[depth:]
                    break
                if open_tags[depth][0] in _BLOCK:
                    break
        if name in _RAW:  # nothing inside is markup until its end tag
            at = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at).end()
            continue
        if name == "body":  # also where the head was left open
            silent = False
        open_tags.append((name, zone, silent))
        mark, hidden = _ATTRIBUTES[attributes] if attributes.strip() else (PLAIN, False)
        if name in ("html", "body"):
            mark = PLAIN
        enter(_inner_zone(name, mark, zone), silent or hidden or name in _SILENT)
    close()
    return out


def host_of(url: str) -> Column:
    """Digest of the lower-case host of a URL column; all rows without one share a host."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.xxhash64(F.lower(host))


def window_digests(tokens: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Digest of the ``width`` tokens from each position of a token stream (64-bit tokens)."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[i:i + n]
            out ^= out >> np.uint64(29)
    return out


def suffix_ranks(tokens: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Rank of every suffix by its first ``width`` tokens, by prefix doubling; equal prefixes share a rank."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    done = 1
    while done < width:
        step = min(done, width - done)
        second = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), np.int64)))
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + second, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        done += step
    return rank


_HASHES = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), 200_000)


def _hash(words: list[str]) -> np.ndarray:
    return np.array([_HASHES[w] for w in words], np.uint64)


def page_digest(blocks: list[Block]) -> int:
    """Digest of a page's text outside marked furniture (of all its text where there is no other)."""
    kept = [b for b in blocks if b.zone != FURNITURE] or blocks
    text = "\n".join(f"{b.zone}{b.text}" for b in kept)
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64))


def _streams(blocks: list[Block]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Runs of neighbouring blocks in or outside the article: whether in it, each token's block number, the tokens."""
    for article, run in groupby(enumerate(blocks), lambda x: x[1].zone == ARTICLE):
        words, block = [], []
        for i, b in run:
            found = b.text.split(" ")
            words += found
            block += [i] * len(found)
        yield article, np.array(block), _hash(words)


def _short_blocks(block: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, digest) of the blocks of a stream that are shorter than a window."""
    start = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
    for lo, hi in zip(start, [*start[1:], len(block)]):
        if hi - lo < WINDOW:
            yield lo, hi, xxhash.xxh64_intdigest(tokens[lo:hi].tobytes())


def _parsed(batches) -> Iterator[pa.RecordBatch]:
    """The blocks of every page: their zones, a byte each, and their texts, a line each (no text has a line break)."""
    for batch in small_batches(batches):
        pages = [page_blocks(text) for text in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([bytes(b.zone for b in blocks) for blocks in pages], pa.binary()),
             pa.array(["\n".join(b.text for b in blocks) for blocks in pages], pa.string())],
            names=[*batch.schema.names[:-1], "zones", "blocks"])


def _blocks(batch) -> Iterator[list[Block]]:
    for zones, texts in zip(batch.column("zones").to_pylist(), batch.column("blocks").to_pylist()):
        yield [Block(z, t) for z, t in zip(zones, texts.split("\n"))] if zones else []


def _host_tokens(batches) -> Iterator[pa.RecordBatch]:
    """Per batch: pages by (host, hashed token), and the digest and id of every page."""
    for batch in batches:
        seen: dict[int, list[np.ndarray]] = {}
        known: set[tuple[int, int, int]] = set()
        for part in small_batches([batch]):
            for page, host, blocks in zip(*(part.column(c).to_pylist() for c in ("page", "host")), _blocks(part)):
                if blocks:
                    known.add((host, page_digest(blocks), page))
                    words = {w for b in blocks for w in b.text.split(" ")}
                    seen.setdefault(host, []).append(np.unique(_hash(list(words)) % np.uint64(BUCKETS)).astype(np.int32))
        if known:
            host, digest, page = zip(*known)
            n = len(host)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.int64()), pa.nulls(n, pa.int32()), pa.array(digest, pa.int64()), pa.array(page, pa.int64()),
                 pa.array([1] * n, pa.int64())], names=["host", "bucket", "copy", "page", "n"])
        for host, found in seen.items():
            bucket, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), host, np.int64)), pa.array(bucket), pa.nulls(len(n), pa.int64()),
                 pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int64))], names=["host", "bucket", "copy", "page", "n"])


def _host_windows(batches) -> Iterator[pa.RecordBatch]:
    """Per batch and host: the distinct windows and short blocks of possible tokens with the pages that have each."""
    names = ["host", "digest", "copy", "page", "article"]
    for batch in batches:
        hosts: dict[int, list[tuple[int, int, bool, np.ndarray]]] = {}
        short: set[tuple] = set()
        for part in small_batches([batch]):
            possible: dict[int, np.ndarray] = {}
            for n, (page, host, blocks) in enumerate(zip(*(part.column(c).to_pylist() for c in ("page", "host")), _blocks(part))):
                if host not in possible:
                    possible[host] = np.zeros(BUCKETS, bool)
                    possible[host][part.column("found")[n].values.to_numpy()] = True
                copy = page_digest(blocks)
                for article, block, tokens in _streams(blocks):
                    may = possible[host][tokens % np.uint64(BUCKETS)]
                    edge = np.flatnonzero(np.diff(may, prepend=False, append=False)).reshape(-1, 2)
                    for lo, hi in edge[edge[:, 1] - edge[:, 0] >= WINDOW].tolist():
                        hosts.setdefault(host, []).append((copy, page, article, tokens[lo:hi]))
                    for lo, hi, digest in _short_blocks(block, tokens):
                        if may[lo:hi].all():
                            short.add((host, digest, copy, page, article))
        if short:
            host, digest, copy, page, article = zip(*short)
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.int64()), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(copy, pa.int64()),
                 pa.array(page, pa.int64()), pa.array(article, pa.bool_())], names=names)
        for host, runs in hosts.items():
            stream = np.concatenate([t for *_, t in runs])
            size = np.array([len(t) for *_, t in runs])
            copy, page, article = (np.repeat(np.array([r[k] for r in runs], kind), size)
                                   for k, kind in enumerate((np.int64, np.int64, np.bool_)))
            last = np.repeat(np.cumsum(size), size)
            at = np.flatnonzero(np.arange(len(stream)) + WINDOW <= last)  # windows do not cross runs
            rank = suffix_ranks(stream)[at]
            order = np.lexsort((article[at], page[at], copy[at], rank))  # the suffix array, equal prefixes by page
            at, rank = at[order], rank[order]
            new = np.ones(len(at), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in (rank, copy[at], page[at], article[at])], axis=0)
            digest = window_digests(stream)[at[new]].view(np.int64)
            at = at[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), host, np.int64)), pa.array(digest), pa.array(copy[at]), pa.array(page[at]),
                 pa.array(article[at])], names=names)


def main_text(blocks: list[Block], repeated: np.ndarray | None = None, in_articles: np.ndarray | None = None) -> str:
    """Article blocks of a page, or, without an article, its loose blocks, without what is repeated.

    ``repeated``: digests of the host's repeated windows and short blocks;
    ``in_articles``: those of them that go from articles too.
    """
    main = ARTICLE if any(b.zone == ARTICLE for b in blocks) else LOOSE
    away = in_articles if main == ARTICLE else repeated
    gone: dict[int, np.ndarray] = {}
    if away is not None and len(away):
        for article, block, tokens in _streams(blocks):
            if article != (main == ARTICLE):
                continue
            covered, inside = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
            for at in np.flatnonzero(np.isin(window_digests(tokens), away)).tolist():
                covered[at:at + WINDOW] = True
                if block[at] == block[at + WINDOW - 1]:
                    inside[at:at + WINDOW] = True
            for lo, hi, digest in _short_blocks(block, tokens):
                if np.uint64(digest) in away:
                    covered[lo:hi] = True
            for i in np.unique(block[covered]).tolist():
                here = block == i
                # windows from a neighbour take a block as a whole or not at all
                gone[i] = covered[here] if covered[here].all() else inside[here]
    out = []
    for i, b in enumerate(blocks):
        if b.zone != main:
            continue
        text = b.text
        if i in gone:
            text = " ".join(w for w, off in zip(text.split(" "), gone[i].tolist()) if not off)
        if text:
            out.append(text)
    return "\n".join(out)


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found, texts = {}, []
        for n, (host, blocks) in enumerate(zip(batch.column("host").to_pylist(), _blocks(batch))):
            if host not in found:
                lists = (batch.column(c)[n].values for c in ("found", "in_articles"))
                found[host] = [None if x is None else x.to_numpy().view(np.uint64) for x in lists]
            texts.append(main_text(blocks, *found[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _by_host(pages: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """``pages`` with what was found on their host; ``hosts`` is durable and broadcast where it is measured to be small."""
    size = hosts.agg(F.sum(F.size("found") + 1)).first()[0] or 0
    return pages.join(F.broadcast(hosts) if size <= _BROADCAST else hosts, "host", how)


def repeated_text(rows: DataFrame) -> DataFrame:
    """``host, found, in_articles``: digests of the repeated windows and short blocks of each host of ``page, host, zones, blocks``."""
    counts = durable(rows.mapInArrow(_host_tokens, "host long, bucket int, copy long, page long, n long")
                     .groupBy("host", "bucket", "copy").agg(F.min("page").alias("page"), F.sum("n").alias("n"))
                     .where((F.col("n") >= MIN_PAGES) | F.col("bucket").isNull()))
    # pages with one text are one page, and so are rows with one id
    total = (counts.where("bucket is null").select("host", "page").distinct()
             .groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    least = F.greatest(F.lit(MIN_PAGES), F.col("pages") * SHARE)
    possible = durable(counts.where("bucket is not null").join(total, "host").where(F.col("n") >= least)
                       .groupBy("host").agg(F.collect_list("bucket").alias("found")))
    windows = (_by_host(rows, possible, "inner").select("page", "host", "zones", "blocks", "found")
               .mapInArrow(_host_windows, "host long, digest long, copy long, page long, article boolean")
               .groupBy("host", "digest", "copy").agg(F.min("page").alias("page"), F.max("article").alias("article"))
               .groupBy("host", "digest", "page").agg(F.max(F.col("article").cast("int")).alias("article"))
               .groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("article").alias("n_articles"))
               .where(F.col("n") >= MIN_PAGES))
    return durable(windows.join(total, "host").where(F.col("n") >= least).groupBy("host").agg(
        F.collect_list("digest").alias("found"),
        F.collect_list(F.when(F.col("n_articles") >= MIN_PAGES, F.col("digest"))).alias("in_articles")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; ``text`` is empty where there is none.

    Null html is empty; null urls share a host without a name; rows with one
    page_id are one page for the count of distinct pages, and each gets its
    text; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("page"), host_of("url").alias("host"),
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = written(rows.mapInArrow(_parsed, "page_id long, url string, page long, host long, zones binary, blocks string"), "blocks")
    found = repeated_text(rows.select("page", "host", "zones", "blocks"))
    return (_by_host(rows.drop("page"), found, "left").select("page_id", "url", "zones", "blocks", "host", "found", "in_articles")
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))
