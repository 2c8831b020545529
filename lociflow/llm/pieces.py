"""Sampled segmentation over a SentencePiece vocabulary, and lossless decoding.

All segmentations of a text into pieces form a lattice. Forward filtering sums, for every position,
the weights of all ways to reach it; backward sampling then draws one whole segmentation from the
exact distribution, each cut with a random number that depends on the row's key and the cut's place
alone. So a row gets the same pieces on any cluster, in any batch.

The vocabulary's pieces never cross into a run of spaces, so the lattice falls apart at such runs. Equal
parts share their forward sums, which a task keeps from batch to batch up to ``CACHE_ROWS`` characters.
Parts of more than ``LONG_CHARS`` characters are gone through in windows, forwards and then backwards,
so their memory doesn't grow with the lattice. A part's own length alone decides how its sums are made,
so they never depend on what else is in a batch. A piece's weight is ``(rank + RANK_SHIFT) ** -theta``. A space
is U+2581 in pieces; characters outside the vocabulary, and U+2581 itself, are spelt in byte pieces.
No space is put in front of a text: decoding gives back exactly what was encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh
from .neardup import _mix

THETA, SEED, RANK_SHIFT = 1.0, 23, 50.0
#: Weight of a character that is spelt in bytes, as a natural logarithm.
BYTE_LOG = -25.0
#: Characters segmented together, and cells of one forward table.
BATCH_CHARS, MAX_CELLS = 1 << 19, 1 << 19
LINEAR_CHARS, LONG_CHARS, WINDOW = 24, 2048, 1 << 16
#: Characters whose forward sums a task keeps at most (96 bytes each).
CACHE_ROWS = 1_000_000
#: log2 of the slots that tell which hashes can't be pieces.
_SIEVE_BITS = 20
_LEAST, _LIFT = 1e-150, 1e150
_SLICE_ROWS = 1024
SPACE, _STAND_IN = 0x2581, 0xE000
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_loaded: dict = {}


def vocabulary(path: str | None = None) -> str:
    """Path of the model file, in the installed public vocabularies unless given."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _char_values(codes: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(np.uint64) + np.uint64(77)) | np.uint64(1)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points as they are, and as the vocabulary spells them."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    code = raw.copy()
    code[raw == SPACE] = _STAND_IN
    code[raw == 32] = SPACE
    return raw, code


def _begins(code: np.ndarray) -> np.ndarray:
    """Where a part begins that no piece crosses into (the first place only if the text says so)."""
    begin = np.zeros(len(code), bool)
    begin[1:] = (code[1:] == SPACE) & (code[:-1] != SPACE) | (code[1:] == 10) | (code[:-1] == 10)
    return begin


def _prefixes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, down): ``(total[b] - total[a]) * down[a]`` is the hash of the characters from a to b."""
    n = len(code)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _B, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _B_INV, np.uint64)]))
        return np.concatenate([[np.uint64(0)], np.cumsum(_char_values(code) * up[:n], dtype=np.uint64)]), down


def _uniform(keys: np.ndarray, cut: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(keys ^ _mix(cut.astype(np.uint64) + np.uint64(1))) >> np.uint64(11)) * 2.0**-53


class _Sums:
    """Forward sums of units by their hash, in rows of ``share`` and ``piece``."""

    def __init__(self, width: int):
        self.width = width
        self.release()

    def release(self) -> None:
        """Gives the memory back: a worker may go on to tasks of other stages."""
        self.share, self.piece = np.zeros((0, self.width), np.float32), np.zeros((0, self.width), np.int16)
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.used = 0

    def missing(self, units: list[int], sizes: np.ndarray) -> list[int]:
        """Numbers of the units that aren't kept yet. Makes room for them: what the batch doesn't use
        goes once the room is short."""
        new = [i for i, u in enumerate(units) if u not in self.row]
        if self.used + int(sizes[new].sum()) > CACHE_ROWS:
            self.clear()
            new = list(range(len(units)))
        return new

    def rows_of(self, units: list[int]) -> np.ndarray:
        return np.array([self.row[u] for u in units], np.int64)

    def add(self, units: list[int], sizes: np.ndarray, share: np.ndarray, piece: np.ndarray) -> None:
        end = self.used + len(share)
        if end > len(self.share):
            room = max(end, min(2 * len(self.share), CACHE_ROWS), 1 << 16)
            for name in ("share", "piece"):
                old = getattr(self, name)
                grown = np.zeros((room, self.width), old.dtype)
                grown[: self.used] = old[: self.used]
                setattr(self, name, grown)
        w = share.shape[1]
        self.share[self.used : end, :w], self.piece[self.used : end, :w] = share, piece
        self.share[self.used : end, w:] = 2.0  # longer than the unit: never drawn
        self.row.update(zip(units, (self.used + np.cumsum(sizes) - sizes).tolist(), strict=True))
        self.used = end


class Pieces:
    """Vocabulary, lattice and sampler."""

    def __init__(self, path: str | None = None, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
        names, ids, ranks = [], [], []
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                names.append(name)
                ids.append(i)
                ranks.append(min(-sp.get_score(i), float(sp.get_piece_size())))
                self.bytes_of.append(name.replace(chr(SPACE), " ").encode())
        self.longest = max(map(len, names))
        self.log_weight = -theta * np.log(np.array(ranks) + RANK_SHIFT)
        self.byte_log = theta * BYTE_LOG
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest, _B, np.uint64)]))
        keys = np.array([(_char_values(np.frombuffer(n.encode("utf-32-le"), np.uint32)) * powers[: len(n)]).sum(dtype=np.uint64) for n in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.log_weight = keys[order], np.array(ids)[order], self.log_weight[order]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.keys >> np.uint64(64 - _SIEVE_BITS)] = True
        # by index + 2: no piece, a character in bytes, then the pieces
        self.log_table = np.concatenate([[-np.inf, self.byte_log], self.log_weight])
        self.table = np.exp(self.log_table)
        self.sums = _Sums(self.longest)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.sieve[h >> np.uint64(64 - _SIEVE_BITS)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == h[maybe], at, -1)
        return out

    def segment(self, texts: list[str], row_keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text; texts together should have about ``BATCH_CHARS`` characters, but for
        one that is longer itself: that is cut at its parts' limits."""
        if len(texts) == 1 and len(texts[0]) > BATCH_CHARS:
            return [self._segment_long_text(texts[0], row_keys)]
        return self._segment(texts, row_keys, 0)

    def _segment_long_text(self, text: str, row_keys: np.ndarray) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            end, size = len(text), BATCH_CHARS
            while at + size < len(text):  # back to the last limit, or on until there is one
                limits = np.flatnonzero(_begins(_codes(text[at : at + size])[1]))
                if len(limits):
                    end = at + int(limits[-1])
                    break
                size *= 2
            out.append(self._segment([text[at:end]], row_keys, at)[0])
            at = end
        return np.concatenate(out)

    def _segment(self, texts: list[str], row_keys: np.ndarray, first_place: int) -> list[np.ndarray]:
        lens = np.array([len(t) for t in texts], np.int64)
        raw, code = _codes("".join(texts))
        n = len(code)
        if not n:
            return [np.zeros(0, np.int64) for _ in texts]
        doc = np.repeat(np.arange(len(texts)), lens)
        doc_start = np.concatenate([[0], np.cumsum(lens)])
        begin = _begins(code)
        begin[doc_start[:-1][lens > 0]] = True
        start = np.flatnonzero(begin)
        size = np.diff(np.append(start, n))
        owner = doc[start]
        keys, place = row_keys[owner], start - doc_start[owner] + first_place
        chosen = np.full(n, -2, np.int64)  # by place: -2 no piece begins, -1 a character in bytes, else an index
        for i in np.flatnonzero(size > LONG_CHARS).tolist():
            self._long(code[start[i] : start[i] + size[i]], int(place[i]), keys[i], chosen[start[i] : start[i] + size[i]])
        short = np.flatnonzero(size <= LONG_CHARS)
        if len(short):
            total, down = _prefixes(code)
            s, m = start[short], size[short]
            whole = _mix((total[s + m] - total[s]) * down[s] + m.astype(np.uint64))
            units, first, which = np.unique(whole, return_index=True, return_inverse=True)
            known = units.tolist()
            new = np.array(self.sums.missing(known, m[first]), np.int64)
            if len(new):
                self._learn(total, down, s[first][new], m[first][new], units[new].tolist())
            self._draw(self.sums.rows_of(known)[which], s, m, place[short], keys[short], chosen)
        return self._spell(chosen, raw, doc_start)

    def _learn(self, total, down, s, m, units: list[int]) -> None:
        """Forward sums of the new units at ``s`` with lengths ``m``, in groups of like lengths."""
        order = np.argsort(m, kind="stable")
        at = 0
        while at < len(order):
            top = LINEAR_CHARS if m[order[at]] <= LINEAR_CHARS else 2 * m[order[at]]
            end = at + int(np.searchsorted(m[order[at:]], top, side="right"))
            while end > at + 1 and (end - at) * (m[order[end - 1]] + 1) * self.longest > MAX_CELLS:
                end -= max(1, min(512, (end - at) // 2))
            part = order[at:end]
            self.sums.add([units[i] for i in part], m[part], *self._lattice(total, down, s[part], m[part]))
            at = end

    def _lattice(self, total, down, s, m) -> tuple[np.ndarray, np.ndarray]:
        """(share, piece) of the units, one row for each of their places: for each length, the share of
        the ways to the place that the pieces up to it bring, and the piece's index."""
        n_units, longest = len(s), int(m.max())
        width = min(self.longest, longest)
        # piece[u, j, l - 1]: index of the piece of length l that ends at j
        piece = np.full((n_units, longest + 1, width), -2, np.int16)
        for length in range(1, width + 1):
            u, a = np.nonzero(np.arange(longest - length + 1)[None, :] <= (m - length)[:, None])
            p = s[u] + a
            found = self._find((total[p + length] - total[p]) * down[p])
            if length == 1:
                piece[u, a + 1, 0] = found  # -1: in bytes
            else:
                hit = np.flatnonzero(found >= 0)
                piece[u[hit], a[hit] + length, length - 1] = found[hit]
        # units this short can't underflow, so their sums need no logarithms
        linear = longest <= LINEAR_CHARS
        weight = (self.table if linear else self.log_table)[piece + 2]
        forward = np.full((n_units, longest + 1 + width), 0.0 if linear else -np.inf)  # shifted by width
        forward[:, width] = 1.0 if linear else 0.0
        share = np.empty((n_units, longest + 1, width), np.float32)
        for j in range(1, longest + 1):
            before = forward[:, j : j + width][:, ::-1]
            if linear:
                c = np.cumsum(weight[:, j] * before, axis=1)
                whole = c[:, -1]
                forward[:, width + j] = whole
            else:
                ways = weight[:, j] + before
                top = np.maximum(ways.max(axis=1), -1e300)
                c = np.cumsum(np.exp(ways - top[:, None]), axis=1)
                whole = c[:, -1]
                forward[:, width + j] = np.where(top > -1e300, top + np.log(np.maximum(whole, 1e-300)), -np.inf)
            np.divide(c, np.maximum(whole, 1e-300)[:, None], out=share[:, j])
        mine = np.arange(1, longest + 1)[None, :] <= m[:, None]
        return share[:, 1:][mine], piece[:, 1:][mine]

    def _draw(self, row, start, m, place, keys, chosen) -> None:
        """Draw the pieces of all occurrences: ``row`` is the first of a unit's rows in the kept sums."""
        share, piece = self.sums.share, self.sums.piece
        width = share.shape[1]
        j = m.copy()
        while len(j):
            at = row + j - 1
            ways = share[at]
            length = np.minimum((ways <= _uniform(keys, place + j)[:, None]).sum(axis=1), width - 1)
            got = piece[at, length]
            j = j - (length + 1)
            chosen[start + j] = got
            live = j > 0
            row, start, place, keys, j = row[live], start[live], place[live], keys[live], j[live]

    def _long(self, code: np.ndarray, place: int, key: np.uint64, chosen: np.ndarray) -> None:
        """One unit of any length: window by window, keeping only the last forward sums of each; then
        back, each window's sums made again."""
        starts = list(range(0, len(code), WINDOW))
        ring = [0.0] * (self.longest - 1) + [1.0]  # forward sums of the places before, in one scale
        rings = []
        for at in starts:
            rings.append(ring)
            ring = self._window(code, at, ring, None)
        j = len(code)
        for at, ring in zip(reversed(starts), reversed(rings), strict=True):
            kept: list[list] = []
            self._window(code, at, ring, kept)
            size = min(WINDOW, len(code) - at)
            draw = _uniform(np.full(size, key, np.uint64), place + at + 1 + np.arange(size)).tolist()
            while j > at:
                ways = kept[j - at - 1]
                wanted = draw[j - at - 1] * ways[-1][0]
                _, length, got = next((w for w in ways if w[0] > wanted), ways[-1])
                j -= length
                chosen[j] = got

    def _window(self, code: np.ndarray, at: int, ring: list[float], kept: list | None) -> list[float]:
        """Forward sums of the places behind ``at``; ``kept`` gets (running sum, length, piece) of each."""
        begin, end = max(0, at - self.longest + 1), min(len(code), at + WINDOW)
        total, down = _prefixes(code[begin:end])
        ends, lengths, found = [], [], []
        for length in range(1, min(self.longest, end - begin) + 1):
            a = np.arange(max(0, at + 1 - length - begin), end - begin - length + 1)
            got = self._find((total[a + length] - total[a]) * down[a])
            if length > 1:
                a, got = a[got >= 0], got[got >= 0]
            ends.append(a + length + begin - at - 1)
            lengths.append(np.full(len(a), length))
            found.append(got)
        e, w, f = np.concatenate(ends), np.concatenate(lengths), np.concatenate(found)
        order = np.argsort(e, kind="stable")
        edges = np.searchsorted(e[order], np.arange(end - at + 1)).tolist()
        w, f = w[order].tolist(), f[order].tolist()
        weight = self.table[np.array(f) + 2].tolist()
        sums = list(ring)
        for j in range(end - at):
            whole, ways = 0.0, []
            for i in range(edges[j], edges[j + 1]):
                whole += weight[i] * sums[-w[i]]
                if kept is not None:
                    ways.append((whole, w[i], f[i]))
            sums.append(whole)
            if whole < _LEAST:
                sums[-self.longest :] = [x * _LIFT for x in sums[-self.longest :]]
            if kept is not None:
                kept.append(ways)
        return sums[-self.longest :]

    def _spell(self, chosen, raw, doc_start) -> list[np.ndarray]:
        at = np.flatnonzero(chosen > -2)
        got = chosen[at]
        code = raw[at]
        spelt = got == -1
        count = np.where(spelt, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        out = np.repeat(np.where(spelt, 0, self.ids[np.maximum(got, 0)]), count)
        first = np.concatenate([[0], np.cumsum(count)])
        if spelt.any():
            data = np.frombuffer("".join(map(chr, code[spelt].tolist())).encode(), np.uint8)
            out[np.repeat(spelt, count)] = self.byte_id[data]
        edges = first[np.searchsorted(at, doc_start)]
        return [out[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode()


def _pieces(path: str | None, theta: float) -> Pieces:
    if (path, theta) not in _loaded:
        _loaded[path, theta] = Pieces(path, theta)
    return _loaded[path, theta]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, theta: float = THETA, seed: int = SEED, proof: bool = False) -> DataFrame:
    """``docs`` with ``pieces`` (``pieces_`` if taken), a sampled segmentation of each whole text.

    ``proof`` adds ``pieces_crc32`` (of the ids as little-endian unsigned 32-bit integers), ``text_crc32``
    (of the text that the ids decode to, in UTF-8) and ``lossless`` (whether that is the text).
    Null and empty texts have no pieces. The sample depends on the row's id, ``seed`` and the text;
    repeated rows get equal pieces, and null ids count as one key. All columns are kept.
    """
    out, crc, text_crc, lossless, key = fresh(docs, "pieces", "pieces_crc32", "text_crc32", "lossless", "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), col(id_col)))
    more = [(crc, T.LongType()), (text_crc, T.LongType()), (lossless, T.BooleanType())] if proof else []
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())), *[T.StructField(*x) for x in more]])
    names = list(docs.columns)
    n, text_at = len(names), names.index(text_col)
    added = [out, *[x for x, _ in more]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(vocab, theta)
        try:
            for batch in batches:
                for at in range(0, len(batch), _SLICE_ROWS):
                    yield from coded(model, batch.slice(at, _SLICE_ROWS))
        finally:
            model.sums.release()

    def coded(model: Pieces, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in rows.column(text_at).to_pylist()]
        keys = rows.column(n).to_numpy().view(np.uint64)
        for a, b in _groups(texts):
            found = [x.astype(np.int32) for x in model.segment(texts[a:b], keys[a:b])]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            columns = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(found)))]
            if proof:
                back = [model.decode(x.tolist()) for x in found]
                columns += [
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                    pa.array([t == u for t, u in zip(back, texts[a:b], strict=True)], pa.bool_()),
                ]
            yield pa.RecordBatch.from_arrays([*rows.slice(a, b - a).columns[:n], *columns], [*names, *added])

    return keyed.mapInArrow(run, schema)


def decode(pieces, vocab: str | None = None, theta: float = THETA):
    """Column expression: the text of a column of piece ids; null for null."""
    import pandas as pd

    def run(values: pd.Series) -> pd.Series:
        model = _pieces(vocab, theta)
        return pd.Series([model.decode(v) if v is not None else None for v in values], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(pieces)


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, text_crc32, lossless) of documents: encoded, decoded, compared."""
    coded = encode(docs.select("doc_id", "text"), proof=True)
    return coded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces_crc32", "text_crc32", "lossless")


def op7_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
