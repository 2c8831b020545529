"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature holds ``K`` MinHash values cut to 16 bits. Two documents are candidates if at most
``max_diff`` of the positions differ. The positions are split into ``CHUNKS`` chunks with allowed
errors ``t_i`` such that ``sum(t_i + 1) > max_diff``: by the pigeonhole principle such a pair agrees
on some chunk but for ``t_i`` positions, so indexing each chunk with every choice of ``t_i``
positions left out finds every such pair. Candidates are then confirmed on whole shingle sets.

Documents with equal sets are one node from the start. In each bucket, members are first compared
with one member only, the one that shares most buckets with others. If the bucket's members are then
still in different components, the remaining pairs are compared tile by tile: each pair in the first
index on which its signatures agree, first by signature, then by sets of 32-bit hashes, so that
nothing but likely links leaves a tile. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop_since, drop_stored, fresh, marker, stored

SHINGLE, K, CHUNKS = 5, 64, 16
#: Standard deviations between the mean distance at the similarity threshold and ``max_diff``.
MARGIN = 3.9
#: Pairs of one node that are confirmed together, about.
PAIRS = 256
#: Members of one tile side, about; nodes whose ids are broadcast at most (8 bytes each).
TILE, MAX_BROADCAST_IDS = 256, 1_000_000
_CHUNK_WORDS = 1 << 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POW = np.full(4096, 0x2545F4914F6CDD1D, np.uint64)
_POW[0] = 1
_POW = np.multiply.accumulate(_POW)
_ODD = _mix(np.arange(1000, 1000 + K, dtype=np.uint64)) | np.uint64(1)
_ADD = _mix(np.arange(2000, 2000 + K, dtype=np.uint64))
_PLACE = _mix(np.arange(3000, 3000 + 8, dtype=np.uint64)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order; letters A-Z count as lower case."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    out = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + 16 * _CHUNK_WORDS)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        part = raw[at:end]
        at = end
        inside = ~_SPACE[part]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if not len(starts):
            continue
        place = np.flatnonzero(inside)
        first = np.zeros(len(part), np.int64)
        first[starts] = starts
        offset = (place - np.maximum.accumulate(first)[place])
        # words over 4096 bytes: the power's period is folded in by the block number
        terms = _BYTE[part[place]] * _POW[offset & 4095] + (offset >> 12).astype(np.uint64) * _BYTE[part[place]]
        out.append(_mix(np.add.reduceat(terms, np.searchsorted(place, starts))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole sequence if shorter."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mix(h + w[i : i + n]) * _PLACE[i]
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[at : at + 4096, None] * _ODD + _ADD).min(axis=0))
    return (_mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


@dataclass(frozen=True)
class Plan:
    """Where similarity ``threshold`` puts the signature distance, and the chunks' allowed errors."""

    threshold: float

    @property
    def max_diff(self) -> int:
        p = 1 - self.threshold
        return int(K * p + MARGIN * (K * p * (1 - p)) ** 0.5)

    def indexes(self) -> list[tuple[int, ...]]:
        """The positions each index keeps. Chunks get ``t`` errors, the first few one more."""
        size = K // CHUNKS
        t, more = divmod(self.max_diff + 1 - CHUNKS, CHUNKS)
        out = []
        for c in range(CHUNKS):
            errors = max(0, t + (c < more))
            out += list(combinations(range(c * size, (c + 1) * size), max(1, size - errors)))
        return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, sigs = [], [], []
        for t in batch.column("text").to_pylist():
            s = shingles(t)
            sizes.append(len(s))
            with np.errstate(over="ignore"):
                node = _mix(np.array([np.bitwise_xor.reduce(_mix(s)) if len(s) else 0], np.uint64) + np.uint64(len(s)) + (s.sum(dtype=np.uint64) if len(s) else np.uint64(0)))[0]
            nodes.append(np.int64(node.view(np.int64)))
            sigs.append(signature(s).tobytes() if len(s) else None)
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], [*others, "node", "n", "sig"])


def _index(indexes: list[tuple[int, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                node = part.column("node").to_numpy()
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, K)
                keys = _keys_of(sig, indexes)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(node, len(indexes)))], ["key", "node"])

    return run


def _keys_of(sig: np.ndarray, indexes: list[tuple[int, ...]]) -> np.ndarray:
    """Keys (indexes, rows) of signatures (rows, K)."""
    wide = sig.astype(np.uint64)
    keys = np.empty((len(indexes), len(sig)), np.uint64)
    for i, keep in enumerate(indexes):
        h = np.full(len(sig), i + 1, np.uint64)
        for at in keep:
            h = (h << np.uint64(16)) ^ (h >> np.uint64(48)) ^ wide[:, at]
            h = h * np.uint64(0x9E3779B97F4A7C15)
        keys[i] = _mix(h)
    return keys.view(np.int64)


def _tiles(plan: Plan, work):
    """Runs ``work(rows, pairs)`` on each tile; ``pairs`` yields (i, others): row numbers of pairs in
    different components, near by signature, whose first common index is the tile's own.

    Rows arrive sorted by (key, ti, tj); a tile has two blocks of about ``TILE`` members.
    """
    indexes, max_diff = plan.indexes(), plan.max_diff

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mark = None

        def tile() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            node, comp, blk = (rows.column(c).to_numpy() for c in ("node", "comp", "blk"))
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, K)
            own = int(np.flatnonzero(_keys_of(sig[:1], indexes)[:, 0] == mark[0])[0])
            left, right = np.flatnonzero(blk == mark[1]), np.flatnonzero(blk == mark[2])

            def pairs():
                for i in left:
                    other = right[(comp[right] != comp[i]) & ((node[right] > node[i]) if mark[1] == mark[2] else True)]
                    if not len(other):
                        continue
                    same = sig[other] == sig[i]
                    near = same.sum(axis=1) >= K - max_diff
                    other, same = other[near], same[near]
                    for keep in indexes[:own]:
                        if not len(other):
                            break
                        new = ~same[:, keep].all(axis=1)
                        other, same = other[new], same[new]
                    if len(other):
                        yield i, other

            yield from work(rows, pairs())

        for batch in batches:
            key, ti, tj = (batch.column(c).to_numpy() for c in ("key", "ti", "tj"))
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(ti) != 0) | (np.diff(tj) != 0)) + 1
            cuts = [0, *change.tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                here = (int(key[x]), int(ti[x]), int(tj[x]))
                if held and here != mark:
                    yield from tile()
                    held.clear()
                mark = here
                held.append(batch.slice(x, y - x))
        if held:
            yield from tile()

    return run


def _pending(rows: pa.Table, pairs) -> Iterator[pa.RecordBatch]:
    """The rows that take part in some pair."""
    used = np.zeros(len(rows), bool)
    for i, other in pairs:
        used[i] = True
        used[other] = True
    if used.any():
        yield from rows.filter(pa.array(used)).combine_chunks().to_batches()


def _likely(percent: int):
    def work(rows: pa.Table, pairs) -> Iterator[pa.RecordBatch]:
        """Pairs whose 32-bit sets are similar enough; equal hashes can only raise the similarity by
        the few that collide, which the allowance covers."""
        node = rows.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint32) for x in rows.column("small").to_pylist()]
        a, b = [], []
        for i, other in pairs:
            for j in other:
                x, y = sets[i], sets[j]
                if 100 * min(len(x), len(y)) + 500 < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True)) + 2
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work


def _small_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "small"])


def _confirm(threshold_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, np.ndarray] = (0, np.zeros(0, np.uint64))
        have = False
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            ok = []
            for i in range(len(a)):
                if not have or known[0] != a[i]:
                    known, have = (a[i], shingles(ta[i].as_py())), True
                s = shingles(tb[i].as_py())
                both = len(np.intersect1d(known[1], s, assume_unique=True))
                ok.append(100 * both >= threshold_percent * (len(known[1]) + len(s) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _distance(max_diff: int) -> Column:
    import pandas as pd

    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p, q = (np.frombuffer(b"".join(v), np.uint16).reshape(-1, K) for v in (x, y))
        return pd.Series((p != q).sum(axis=1) <= max_diff)

    near.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(near, "boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the least node it can reach.

    Alternating large-star and small-star steps; each writes its edges to a shared table. Rounds grow
    with the logarithm of the longest path, and no node's neighbours are ever gathered in one row.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc")
    last = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).union(now.select("v", "v").distinct())
        last = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(small.union(low.select("x", "m")).distinct(), "cc")
        drop_stored(now)
        drop_stored(large)
        now = small


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")


class NearDuplicates:
    """Steps of one run; ``docs`` is (id, text)."""

    def __init__(self, docs: DataFrame, threshold: float):
        self.docs, self.plan, self.percent = docs, Plan(threshold), round(100 * threshold)
        self.mark = marker(docs.sparkSession)
        kind = docs.schema["id"].dataType.simpleString()
        rows = docs.select("id", F.xxhash64("text").alias("text_hash"), "text")
        self.rows = stored(rows.mapInArrow(_sign, f"id {kind}, text_hash long, node long, n long, sig binary"), "near-rows")
        some = self.rows.filter("n > 0")
        self.nodes = stored(some.groupBy("node").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "near-nodes")

    def links(self) -> DataFrame:
        """Confirmed links (a, b) between nodes, enough of them to give the components.

        What is known of each bucket is stored before its members join it: a join that reads both sides
        from shuffles of its own is one that adaptive execution splits where a bucket is large.
        """
        keys = self.nodes.select("node", "sig").mapInArrow(_index(self.plan.indexes()), "key long, node long")
        sizes = keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
        sizes = stored(sizes, "near-sizes")
        buckets = stored(keys.join(sizes, "key"), "near-buckets")
        # a group's original shares more buckets with its copies than they do with each other
        shared = buckets.groupBy("node").agg(F.sum("members").alias("shared"))
        heads = buckets.join(shared, "node").groupBy("key").agg(F.max(F.struct("shared", "node")).alias("top")).select("key", F.col("top.node").alias("head"))
        heads = stored(heads, "near-heads")
        first = stored(buckets.join(heads, "key").filter("node != head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct(), "near-first")
        found = stored(self.confirm(self.close(first)), "near-links")
        comp = components(found)
        named = buckets.filter("members > 2").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = named.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("m")).filter("c1 != c2").select("key", "m")
        mixed = stored(mixed, "near-mixed")
        rest = named.join(mixed, "key").join(self.nodes.select("node", "sig"), "node")
        n_blocks = F.ceil(F.col("m") / TILE).cast("int")
        blk = F.pmod(F.xxhash64("node", "key"), n_blocks).cast("int")
        tiled = rest.select("key", "node", "comp", "sig", blk.alias("blk"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("o"))
        tiled = tiled.select("key", "node", "comp", "sig", "blk", F.least("blk", "o").alias("ti"), F.greatest("blk", "o").alias("tj"))
        schema = "key long, node long, comp long, sig binary, blk int, ti int, tj int"
        pending = stored(_by_tile(tiled).mapInArrow(_tiles(self.plan, _pending), schema), "near-pending")
        wanted = pending.select("node").distinct().join(self.nodes.select("node", "id"), "node")
        small = self.texts_of(stored(wanted, "near-wanted")).mapInArrow(_small_sets, "node long, small binary")
        second = _by_tile(pending.join(small, "node")).mapInArrow(_tiles(self.plan, _likely(self.percent)), "a long, b long").distinct()
        more = stored(self.confirm(second), "near-links")
        return found.union(more)

    def close(self, pairs: DataFrame) -> DataFrame:
        sig = self.nodes.select("node", "sig")
        both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
        return both.filter(_distance(self.plan.max_diff)("sa", "sb")).select("a", "b")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose whole shingle sets are similar enough. Only texts of their nodes are moved.

        A node with many pairs (the original of a large group) is split: its pairs are dealt to runs of
        about ``PAIRS``, and each run gets the text of its own.
        """
        pairs = stored(pairs, "near-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("runs")).join(self.nodes.select("node", "id"), "node")
        wanted = stored(wanted, "near-wanted")
        texts = self.texts_of(wanted)
        copies = texts.join(wanted.select("node", "runs"), "node").select("node", "text", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"))
        many = wanted.filter("runs > 1").select("node", "runs")  # a few: each stands for PAIRS pairs
        split = pairs
        for side, other in (("a", "b"), ("b", "a")):
            split = split.join(many.toDF(side, f"runs_{side}"), side, "left").withColumn(f"run_{side}", F.pmod(F.xxhash64(other), F.coalesce(f"runs_{side}", F.lit(1))).cast("int")).drop(f"runs_{side}")
        both = split.join(copies.toDF("b", "text_b", "run_b"), ["b", "run_b"]).join(copies.toDF("a", "text_a", "run_a"), ["a", "run_a"])
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(self.percent), "a long, b long")

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """(node, text): one text for each wanted node. Its ids are broadcast while they are few."""
        if wanted.count() <= MAX_BROADCAST_IDS:
            ids = F.broadcast(wanted.select("id").distinct())
        else:
            ids = wanted.select("id").distinct()
        rows = self.docs.join(ids, self.docs["id"].eqNullSafe(ids["id"]), "left_semi")
        # an id that is null or repeated may bring other texts: the node decides
        kind = self.docs.schema["id"].dataType.simpleString()
        nodes = rows.mapInArrow(_with_node, f"id {kind}, node long, text string")
        one = nodes.join(wanted.select("node").withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left_semi")
        return one.groupBy("node").agg(F.first("text").alias("text"))

    def survivors(self) -> DataFrame:
        """(id, text_hash) of one row with words of each component: its least id, null last."""
        comp = components(self.links())
        named = self.rows.filter("n > 0").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("row"))
        return self._last(stored(least.select("row.id", "row.text_hash"), "near-kept"))

    def classes(self) -> DataFrame:
        """(node, component): component is the least id in the node's component."""
        comp = components(self.links())
        named = self.nodes.select("node", "id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("id").alias("component"))
        return self._last(stored(named.join(least, "comp").select("node", "component"), "near-classes"))

    def _last(self, result: DataFrame) -> DataFrame:
        """``result``, once no other table of this run but the rows is needed."""
        drop_since(self.docs.sparkSession, self.mark, result, self.rows)
        return result


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for signed in _sign(iter([batch])):
            yield pa.RecordBatch.from_arrays([batch.column("id"), signed.column("node"), batch.column("text")], ["id", "node", "text"])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Rows are linked if their sets of five-word shingles have Jaccard similarity ``threshold`` or more;
    a component is named by its least id. Rows without words have an empty set and stand alone.
    Equal texts fall in one component. A null id never names a component unless all its ids are null;
    then component_id is null and kept true. Extra columns are not read.
    """
    run = NearDuplicates(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")), threshold)
    rows = run.rows.join(run.classes(), "node", "left")
    comp = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = rows.select("id", F.col("n").alias("n_shingles"), comp.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: its least id, of that id's texts the one of least hash
    (rows equal in id and text: one of them). Null and repeated ids stand for any number of documents.

    Rows without words are all kept.
    """
    text = col(text_col).cast("string")
    kept_id, kept_hash, text_hash = fresh(docs, "kept_id", "kept_hash", "text_hash")
    wordless = ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = NearDuplicates(docs.select(col(id_col).alias("id"), text.alias("text")), threshold).survivors().distinct().toDF(kept_id, kept_hash)
    rows = docs.filter(~wordless).withColumn(text_hash, F.xxhash64(text))
    rows = rows.join(kept, (F.col(text_hash) == F.col(kept_hash)) & col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    rows = rows.dropDuplicates([id_col, text_hash]).drop(text_hash)
    return rows.unionByName(docs.filter(wordless))


def op6_minhash_hamming(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, 0.85)
