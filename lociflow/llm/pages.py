"""Main text of web pages: block structure, and sorted host suffixes.

Each page is parsed into blocks. Blocks of menus, headers, footers, side bars, notices, adverts,
forms and comments are known by their elements and names. If a page marks its article (``article``,
``main`` or a container named so), the rest of that container may be text, else all the rest may.
The token streams of all the host's pages are then taken together: suffixes, cut to ``RUN`` tokens
of a block or to a few whole blocks, are sorted across the cluster, and neighbours in that order that
agree are repeats. Tokens that repeats on ``MANY`` distinct pages cover are boilerplate, in marked
articles too, but for those that repeats cover by more than half: they are copies of each other.

Cut suffixes are sorted by a hash that holds the host: equal ones are neighbours, as they would be in
the host's suffix array, but the order between unequal ones is not that of their tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stored
from .neardup import _mix, word_hashes

#: Tokens of one block, or of whole blocks in a row, that must be repeated to count as boilerplate.
RUN, BLOCK_RUN = 30, 5
#: Distinct pages of the host, and part of them, that must have the repeat.
MANY, SHARE = 4, 0.05
#: Tokens of the runs by which suffixes that can't be repeated are left out before the sort.
GRAM = 10
#: Grams, or repeats of pages, that are broadcast at most (8 bytes each).
MAX_BROADCAST = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
SKIP = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg canvas object audio video dialog menu".split())
SKIP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments disqus reply replies respond share sharing social related recommended widget widgets search login toolbar pagination pager skip".split()
)
#: These are boilerplate outside an article only; inside they hold its title.
SKIP_OUTSIDE = frozenset("header masthead topbar".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements that hold the text itself: what their names say is about the page's layout.
NAMED_FREELY = frozenset("html body main article".split())
CONTENT_NAMES = frozenset("content article post entry story main maincontent articlebody".split())
_SPLIT = re.compile(r"[^0-9a-z]+")
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """``blocks``: (rank, skipped, text) of all blocks that are shown, boilerplate too; rank 3 in an
    article, 2 in main, 1 in a named container, 0 else. An article or the like that opens below an
    element skipped for its name only has its rank less 10: that name may be the layout's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # element, skipped (1: by a name only, 2: for good), rank
        self.text: list[str] = []
        self.blocks: list[tuple[int, bool, str]] = []

    def _state(self) -> tuple[int, int]:
        return self.open[-1][1:] if self.open else (0, 0)

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if text:
                skipped, rank = self._state()
                if not any(e[0] in ("script", "style", "head") for e in self.open):
                    self.blocks.append((rank, bool(skipped), text))

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag in BLOCK:
                self.flush()
            return
        skipped, rank = self._state()
        named = {k: (v or "").lower() for k, v in attrs}
        names = set(_SPLIT.split(named.get("class", ""))) | set(_SPLIT.split(named.get("id", "")))
        role = named.get("role", "").strip()
        inside = rank in (3, -7)
        skip = 2 * (tag in SKIP or role in SKIP_ROLES or "hidden" in named or named.get("aria-hidden") == "true" or (not rank and tag == "header"))
        if not skip and (inside or tag not in NAMED_FREELY) and names & (SKIP_NAMES if rank else SKIP_NAMES | SKIP_OUTSIDE):
            skip = 2 if inside else 1
        new_rank = 3 if tag == "article" else 2 if tag == "main" or role == "main" else 1 if tag in BLOCK and tag not in ("html", "body", "p", "li") and names & CONTENT_NAMES else 0
        if tag in BLOCK or bool(skip) != bool(skipped):
            self.flush()
        elif tag in ("td", "th", "option"):
            self.text.append(" ")
        if tag == "p":  # a paragraph ends the one before
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    del self.open[i:]
                    break
                if self.open[i][0] in BLOCK:
                    break
            skipped, rank = self._state()
        if skipped == 1 and not skip and new_rank > max(rank, 0):
            self.open.append((tag, 0, new_rank - 10))
        else:
            self.open.append((tag, max(skipped, skip), max(rank, new_rank) if rank >= 0 else max(rank, new_rank - 10 if new_rank else rank)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCK or any(e[0] in BLOCK for e in self.open[i:]) or self.open[i][1]:
                    self.flush()
                del self.open[i:]
                return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        self.text.append(data)


def parse(html: str | None) -> tuple[bool, str, list[str], list[bool]]:
    """(marked, text, blocks, own): whether the page marks its article; the text by structure alone;
    all blocks that are shown; and which of them make up that text."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    size: dict[int, int] = {}
    for rank, skipped, text in parser.blocks:
        if not skipped:
            size[rank] = size.get(rank, 0) + len(text)
    best = max((rank for rank in size if rank > 0), default=0)
    low = max((rank for rank in size if rank < 0), default=0)
    if low and best < 3 and (low > -9 or not best) and size[low] > size.get(best, 0):
        best = low
    own = [rank == best and not skipped for rank, skipped, _ in parser.blocks]
    blocks = [text for *_, text in parser.blocks]
    return bool(best), "\n".join(t for t, o in zip(blocks, own, strict=True) if o), blocks, own


def host_of(url: str | None) -> str:
    rest = (url or "").strip()
    rest = rest.partition("://")[2] or rest
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def suffixes(pages: list[tuple[list[str], list[bool], int]]) -> tuple[np.ndarray, ...]:
    """(page, gram, run, start, length) of the cut suffixes of pages (blocks, own, host).

    A suffix that has ``RUN`` tokens in its block is cut to these. One at a block's start is cut to the
    fewest whole blocks, own or not own alike, that have ``BLOCK_RUN`` tokens. ``run`` hashes host and
    cut suffix; ``gram`` is the least hash of the ``GRAM`` tokens' runs in it, so suffixes with equal
    ``run`` have equal ``gram``. ``start`` counts from the first page's first token.
    """
    texts = [t for blocks, *_ in pages for t in blocks]
    w = word_hashes("\n".join(texts))
    size = np.array([t.count(" ") + 1 for t in texts], np.int64)
    page = np.repeat(np.arange(len(pages)), [len(blocks) for blocks, *_ in pages])
    own = np.array([o for _, flags, _ in pages for o in flags], bool)
    host = np.array([h for *_, h in pages], np.int64).view(np.uint64)
    end = np.cumsum(size)
    begin = end - size
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _powers(_BASE, len(w)), dtype=np.uint64)])
    back = _powers(_BACK, len(w) + 1)

    def cut(at, length):
        return (sums[at + length] - sums[at]) * back[at]

    at = np.flatnonzero(np.arange(len(w)) + RUN <= np.repeat(end, size))
    owner = np.repeat(page, size)[at]
    run = _mix(cut(at, RUN) + _mix(host[owner] + np.uint64(1)))
    if len(at):
        small = _mix(cut(np.arange(len(w) - GRAM + 1), GRAM))
        gram = _mix(np.lib.stride_tricks.sliding_window_view(small, RUN - GRAM + 1).min(axis=1)[at] + _mix(host[owner]))
    else:
        gram = run
    last = np.searchsorted(end, begin + BLOCK_RUN)
    segment = np.cumsum(np.concatenate([[True], (page[1:] != page[:-1]) | (own[1:] != own[:-1])])) if len(page) else page
    first = np.flatnonzero(last < len(end))
    first = first[segment[first] == segment[last[first]]]
    length = end[last[first]] - begin[first]
    whole = _mix(cut(begin[first], length) + _mix(host[page[first]] + np.uint64(2)) + _mix(((last[first] - first) * 65537 + length).astype(np.uint64)))
    join = lambda *x: np.concatenate(x)
    return join(owner, page[first]), join(gram, whole).view(np.int64), join(run, whole).view(np.int64), join(at, begin[first]), join(np.full(len(at), RUN), length)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse(h) for h in batch.column("html").to_pylist()]
        hosts = [host_of(u) for u in batch.column("url").to_pylist()]
        marked, text, blocks, own = zip(*rows, strict=True) if rows else ((),) * 4
        columns = [pa.array(hosts, pa.string()), pa.array(marked, pa.bool_()), pa.array(text, pa.string()), pa.array(blocks, pa.list_(pa.string())), pa.array(own, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), batch.column("url"), *columns], ["k", "id", "url", "host", "marked", "text", "blocks", "own"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            yield part, suffixes(list(zip(*(part.column(c).to_pylist() for c in ("blocks", "own", "host")), strict=True)))


def _once(page: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Row numbers of distinct (page, value)."""
    order = np.lexsort((value, page))
    p, v = page[order], value[order]
    return order[np.concatenate([[True], (p[1:] != p[:-1]) | (v[1:] != v[:-1])])] if len(order) else order


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, (page, gram, *_) in _parts(batches):
        yield pa.RecordBatch.from_arrays([pa.array(gram[_once(page, gram)])], ["gram"])


def _suffixes(wanted):
    """(run, same, host, k) of each page's cut suffixes; of those with a wanted gram, if any are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (page, gram, run, *_) in _parts(batches):
            if wanted is not None:
                near = np.minimum(np.searchsorted(wanted.value, gram), max(len(wanted.value) - 1, 0))
                found = wanted.value[near] == gram if len(wanted.value) else np.zeros(len(gram), bool)
                page, run = page[found], run[found]
            rows = _once(page, run)
            columns = [part.column(c).take(pa.array(page[rows])) for c in ("same", "host", "k")]
            yield pa.RecordBatch.from_arrays([pa.array(run[rows]), *columns], ["run", "same", "host", "k"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, n): distinct pages ``same`` of each cut suffix in ``MANY`` or more; rows sorted by (run, same)."""
    now, before, n = None, None, 0
    for batch in batches:
        run, same = batch.column("run").to_numpy(), batch.column("same").to_numpy()
        if not len(run):
            continue
        new = np.concatenate([[run[0] != now], run[1:] != run[:-1]])
        other = new | np.concatenate([[same[0] != before], same[1:] != same[:-1]])
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(other.astype(np.int64), np.concatenate([[0], starts[starts > 0]]))
        runs, totals = run[np.concatenate([[0], starts[starts > 0]])].tolist(), counts.tolist()
        if new[0]:
            runs, totals = [now, *runs], [n, *totals]
        else:
            totals[0] += n
        now, before, n = runs[-1], same[-1], totals[-1]
        done = [(r, t) for r, t in zip(runs[:-1], totals[:-1], strict=True) if t >= MANY]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([t for _, t in done], pa.int64())], ["run", "n"])
    if n >= MANY:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64())], ["run", "n"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' own blocks without the tokens that repeats cover."""
    for batch in batches:
        out = []
        for blocks, own, host, marked, runs in zip(*(batch.column(c).to_pylist() for c in ("blocks", "own", "host", "marked", "runs")), strict=True):
            kept = [t for t, o in zip(blocks, own, strict=True) if o]
            if runs:
                _, _, run, start, length = suffixes([(blocks, own, host)])
                size = [t.count(" ") + 1 for t in blocks]
                step = np.zeros(sum(size) + 1, np.int64)
                hit = np.isin(run, np.array(runs, np.int64))
                np.add.at(step, start[hit], 1)
                np.add.at(step, (start + length)[hit], -1)
                covered = np.cumsum(step)[:-1] > 0
                mine = np.repeat(np.array(own, bool), size)
                if marked and 2 * np.count_nonzero(covered & mine) > np.count_nonzero(mine):
                    covered[:] = False
                kept, at = [], 0
                for text, o, n in zip(blocks, own, size, strict=True):
                    gone = covered[at : at + n]
                    at += n
                    if o and not gone.all():
                        kept.append(" ".join(w for w, g in zip(text.split(" "), gone.tolist(), strict=True) if not g) if gone.any() else text)
            out.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row. Null or empty html gives an empty text; a page without a host
    (null url) is left as its structure says; pages of a host with equal texts count as one page when
    repeats are sought. Extra columns are not read."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.monotonically_increasing_id().alias("k"), col(id_col).alias("id"), col(url_col).alias("url"), col(html_col).alias("html"))
    parsed = rows.mapInArrow(_parse, f"k long, id {kind}, url string, host string, marked boolean, text string, blocks array<string>, own array<boolean>")
    same, host = F.xxhash64("host", "text").alias("same"), F.xxhash64("host").alias("host")
    parsed = stored(parsed.select("k", "id", "url", (F.col("host") != "").alias("hosted"), "marked", "blocks", "own", same, host), "pages")
    hosted = parsed.filter("hosted")
    # a suffix in many pages has a gram in many pages: few suffixes are left to sort
    grams = hosted.mapInArrow(_grams, "gram long").groupBy("gram").count().filter(F.col("count") >= MANY).select("gram")
    known = grams.limit(MAX_BROADCAST + 1).toPandas()["gram"].to_numpy(np.int64)
    wanted = pages.sparkSession.sparkContext.broadcast(np.sort(known)) if len(known) <= MAX_BROADCAST else None
    found = stored(hosted.mapInArrow(_suffixes(wanted), "run long, same long, host long, k long"), "page-suffixes")
    repeats = found.select("run", "same").repartition("run").sortWithinPartitions("run", "same").mapInArrow(_neighbours, "run long, n long")
    hosts = hosted.groupBy("host").agg(F.count_distinct("same").alias("pages"))
    common = found.join(repeats, "run").join(hosts, "host").filter(F.col("n") >= SHARE * F.col("pages"))
    common = stored(common.select("k", "run"), "page-repeats")
    runs = common.groupBy("k").agg(F.collect_list("run").alias("runs"))  # a page's own repeats
    if common.count() <= MAX_BROADCAST:
        runs = F.broadcast(runs)
    out = parsed.join(runs, "k", "left").select("id", "url", "host", "blocks", "own", "marked", "runs")
    return out.mapInArrow(_without, f"id {kind}, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op8_host_suffixes(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
