"""Token-id files: whole texts as ids of a public tokenizer, in range-coded blocks.

A table of chunks. Each chunk holds whole documents in ascending id order: their ids and numbers of
tokens, and one binary value with the coded token ids (format: :mod:`.rangecoder`). Blocks of a
chunk decode on their own and carry checksums.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import rangecoder
from .common import col, scratch, tasks_for

END_ID = 2
#: A chunk is closed once it holds so many ids (a document is never split over chunks).
CHUNK_IDS = 8 << 20
#: Pieces of text whose ids a worker remembers at most, in two generations; one of at most 15 bytes takes about 60, a longer one about 130.
CACHE = 1_000_000
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces that the tokenizer never joins: its own splitting respects white space in this way.
_PIECE = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: Behind a line's end or none, a word of Latin-1 letters, and signs that byte-level splitting parts from both.
_WORD = re.compile("(\n?)( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_BLANK = re.compile(f"[{_SPACES}]\\Z")
#: Characters whose pieces wait for their ids together; pieces of a longer text that do; words that the model gets as one.
_WAIT, _WAIT_PIECES, _TOGETHER = 1 << 21, 1 << 18, 64
#: 8-byte words of a remembered piece; places tried for a piece in a table.
_SMALL, _LARGE, _PROBES = 2, 8, 32
#: The last bytes of white space in UTF-8, and of other characters.
_BLANK_BYTES = np.isin(np.arange(256), [x.encode()[-1] for x in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))])
_ALNUM, _SIGN = 1, 2
_KINDS = np.array([_ALNUM if chr(x).isalnum() else _SIGN if 32 < x < 127 else 0 for x in range(128)] + [0] * 128, np.uint8)
#: Bytes that no text has, as Python holds them: behind a piece, and where splitting parts one.
_END, _PART = "\udcff", "\udcfe"
_NONE = np.zeros(0, np.uint32)
_loaded: dict = {}


def vocabulary(path: str | None = None) -> str:
    """Path of the tokenizer file, in the installed public vocabularies unless given."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: its own if it is a visible Latin-1
    sign, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(other)) for b in range(256)]


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first``, one behind the other."""
    end = np.cumsum(size)
    return np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _ends(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a line's end before a word or signs, and of ASCII signs behind a letter or digit: the tokenizer's
    splitting always parts both from the rest."""
    if not len(start):
        return start, start
    flat = raw[_runs(start, length)]
    end = np.cumsum(length)
    at = np.where(_KINDS[flat] == _SIGN, -1, np.arange(len(flat)))
    last = np.maximum.reduceat(at, end - length)  # not a sign
    inside = last >= end - length
    last = np.maximum(last, 0)
    kind = _KINDS[flat[last]]
    latin = (last > end - length) & (flat[last - 1] == 0xC3) & (flat[last] != 0x97) & (flat[last] != 0xB7)
    tail = np.where(inside & ((kind == _ALNUM) | latin), end - 1 - last, 0)
    second = flat[np.minimum(end - length + 1, end - 1)]
    head = (flat[end - length] == 10) & (length > 1) & ((_KINDS[second] > 0) | (second == 0xC3))
    return head.astype(np.int64), tail


class _Table:
    """Ids of pieces, found by the pieces' own bytes: ``n_words`` words of 8, the last with the length as its highest byte."""

    def __init__(self, n_words: int):
        at = np.arange(8 * n_words)
        below = at.reshape(1, n_words, 8) < at.reshape(-1, 1, 1)
        self.masks = np.ascontiguousarray((below * np.uint8(255)).view("<u8")[:, :, 0].T)
        self.keys = [np.zeros(0, np.uint64) for _ in range(n_words)]
        self.first, self.size, self.blank, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), _NONE
        self.slots, self.shift = np.full(1 << 10, -1, np.int32), np.uint64(54)

    def __len__(self) -> int:
        return len(self.size)

    def key(self, data: bytes, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The keys of pieces of ``data``, behind which 64 more bytes must be."""
        at = np.ndarray(len(data) - 7, "<u8", data, strides=1)
        key = [at[start + 8 * i] & mask.take(size) for i, mask in enumerate(self.masks)]
        key[-1] |= size.astype(np.uint64) << np.uint64(56)
        return key

    @staticmethod
    def hashed(key: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(key[0]), np.uint64)
        for k in key:
            h ^= k
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h

    def find(self, key: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these keys; -1 if not remembered."""
        found = np.full(len(h), -1, np.int64)
        if not len(self):
            return found
        left, slot = slice(None), (h >> self.shift).astype(np.int64)
        for _ in range(_PROBES):
            n = self.slots.take(slot)
            used = n >= 0
            same = used.copy()
            for mine, k in zip(self.keys, key, strict=True):
                same &= mine.take(n, mode="clip") == k[left]
            found[left] = np.where(same, n, -1)
            more = np.flatnonzero(used & ~same)
            if not len(more):
                break
            left = more if type(left) is slice else left[more]
            slot = slot[more] + 1 & len(self.slots) - 1
        return found

    def add(self, key: list[np.ndarray], size: np.ndarray, blank: np.ndarray, ids: np.ndarray) -> None:
        """Remember different pieces that weren't found."""
        n = len(self)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size, self.blank, self.ids = np.concatenate([self.size, size]), np.concatenate([self.blank, blank]), np.concatenate([self.ids, ids])
        self.keys = [np.concatenate(x) for x in zip(self.keys, key, strict=True)]
        if 2 * len(self) > len(self.slots):
            bits = (2 * len(self)).bit_length()
            self.slots, self.shift, n = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits), 0
        left = np.arange(n, len(self), dtype=np.int32)
        slot = (self.hashed([k[n:] for k in self.keys]) >> self.shift).astype(np.int64)
        for _ in range(_PROBES):  # what finds no place is asked for again
            free = np.flatnonzero(self.slots.take(slot) < 0)
            self.slots[slot[free]] = left[free]
            out = np.flatnonzero(self.slots.take(slot) != left)
            left, slot = left[out], slot[out] + 1 & len(self.slots) - 1


class _Generation:
    """The pieces remembered since the last one was full."""

    def __init__(self) -> None:
        self.tables = _Table(_SMALL), _Table(_LARGE)

    def __len__(self) -> int:
        return sum(map(len, self.tables))


class _Pieces:
    """Ids of texts by their pieces. Pieces that aren't remembered are asked for together."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer

        self.batch = tokenizer.encode_batch_fast
        self.letters = "".join(_byte_letters())
        model, vocab = tokenizer.model, tokenizer.get_vocab()
        marks = self.letters[0xFF], self.letters[0xFE]
        self.end, self.part = (vocab.get(x) for x in marks)
        # nothing is merged over a byte that no other entry has, so the model can be asked for many words at once
        plain = not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges)
        apart = None not in (self.end, self.part) and sum(marks[0] in x or marks[1] in x for x in vocab) == 2
        self.bare = Tokenizer(model).encode_batch_fast if plain and apart else None
        self.known, self.older = _Generation(), _Generation()

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts of ``_WAIT`` characters together, or of one longer text."""
        if len(texts) == 1 and len(texts[0]) > _WAIT:
            return [self._slowly(texts[0])]
        parts = [t.encode() for t in texts]
        data = b"".join(parts)
        begin = np.cumsum([0] + [len(x) for x in parts])
        # cut before each space and each line's end: no piece goes over these cuts if none of the parts ends with white space
        raw = np.frombuffer(data, np.uint8)
        cut = (raw == 32) | (raw == 10)
        cut[begin[:-1][begin[:-1] < len(raw)]] = True
        start = np.flatnonzero(cut)
        ids, size, blank = self._ids(data, start, np.diff(start, append=len(raw)))
        self._forget()
        bound = np.searchsorted(start, begin)
        end = np.concatenate([[0], np.cumsum(size)])[bound]
        blank = np.concatenate([[0], np.cumsum(blank)])[bound]
        return [self._slowly(t) if blank[i + 1] > blank[i] else ids[end[i] : end[i + 1]] for i, t in enumerate(texts)]

    def _slowly(self, text: str) -> np.ndarray:
        """The same of one text, its pieces found by the tokenizer's rule for white space."""
        pieces = _PIECE.findall(text)
        out = [_NONE]
        for at in range(0, len(pieces), _WAIT_PIECES):
            some = [x.encode() for x in pieces[at : at + _WAIT_PIECES]]
            size = np.fromiter(map(len, some), np.int64, len(some))
            out.append(self._ids(b"".join(some), np.cumsum(size) - size, size)[0])
            self._forget()
        return np.concatenate(out)

    def _ids(self, data: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the pieces of ``data``, how many each has, and which end with white space."""
        padded = data + bytes(64)
        first, size, blank = np.empty(len(start), np.int64), np.empty(len(start), np.int64), np.empty(len(start), bool)
        pool, base = [], 0
        large = length >= 8 * _SMALL
        far = length >= 8 * _LARGE
        for i, which in enumerate((~large, large & ~far)):
            rows = np.flatnonzero(which)
            table = self.known.tables[i]
            if len(rows):
                at, n_bytes = start[rows], length[rows]
                key = table.key(padded, at, n_bytes)
                h = table.hashed(key)
                n = table.find(key, h)
                new = np.flatnonzero(n < 0)
                if len(new):
                    n[new] = self._learn(i, data, at[new], n_bytes[new], [k[new] for k in key], h[new])
                first[rows], size[rows], blank[rows] = table.first.take(n) + base, table.size.take(n), table.blank.take(n)
            pool.append(table.ids)
            base += len(table.ids)
        rows = np.flatnonzero(far)  # too long to be worth remembering
        if len(rows):
            pieces = [data[a : a + n].decode() for a, n in zip(start[rows].tolist(), length[rows].tolist(), strict=True)]
            ids, some = self._ask(pieces)
            first[rows], size[rows], blank[rows] = np.cumsum(some) - some + base, some, [bool(_BLANK.search(x)) for x in pieces]
            pool.append(ids)
        ids = np.concatenate(pool).take(_runs(first, size))
        return ids, size, blank

    def _forget(self) -> None:
        if len(self.known) >= CACHE // 2:
            self.known, self.older = _Generation(), self.known

    def _learn(self, i: int, data: bytes, start: np.ndarray, length: np.ndarray, key: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """Take in pieces that aren't remembered in table ``i``; their numbers."""
        table, older = self.known.tables[i], self.older.tables[i]
        _, one, same = np.unique(h, return_index=True, return_inverse=True)
        odd = np.flatnonzero(np.any([k != k[one][same] for k in key], axis=0))  # others of the same hash stand alone
        same[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd])
        key, h = [k[one] for k in key], h[one]
        old = older.find(key, h)
        size, blank = np.empty(len(one), np.int64), np.empty(len(one), bool)
        was, new = old >= 0, np.flatnonzero(old < 0)
        size[was], blank[was] = older.size[old[was]], older.blank[old[was]]
        at, n_bytes = start[one[new]], length[one[new]]
        raw = np.frombuffer(data, np.uint8)
        head, tail = _ends(raw, at, n_bytes)
        parted = head + tail > 0
        plain = np.flatnonzero(~parted)
        pieces = [data[a : a + n].decode() for a, n in zip(at[plain].tolist(), n_bytes[plain].tolist(), strict=True)]
        asked, size[new[plain]] = self._ask(pieces)
        blank[new] = False
        for j in np.flatnonzero(_BLANK_BYTES[raw[at[plain] + n_bytes[plain] - 1]]):
            blank[new[plain[j]]] = bool(_BLANK.search(pieces[j]))
        made = _NONE
        if parted.any():  # their parts are pieces, too
            at, n_bytes, head, tail = at[parted], n_bytes[parted], head[parted], tail[parted]
            part = np.stack([head, n_bytes - head - tail, tail], axis=1)
            begin = np.stack([at, at + head, at + n_bytes - tail], axis=1)
            made, some, _ = self._ids(data, begin[part > 0], part[part > 0])
            part[part > 0] = some
            size[new[parted]] = part.sum(axis=1)
        first = np.empty(len(one), np.int64)
        first[was] = older.first[old[was]]
        for which, base in ((plain, len(older.ids)), (parted, len(older.ids) + len(asked))):
            first[new[which]] = base + np.cumsum(size[new[which]]) - size[new[which]]
        n = len(table)
        table.add(key, size, blank, np.concatenate([older.ids, asked, made])[_runs(first, size)])
        return n + same

    def _ask(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one piece's behind the other's, and how many each has."""
        words, others = [], []
        for i, piece in enumerate(pieces):
            # the tokenizer's splitting leaves a word whole, so the model can do without
            if self.bare and piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                words.append(piece)
            elif self.bare and (m := _WORD.fullmatch(piece)):
                words.append(_PART.join(filter(None, m.groups())))
            else:
                words.append("")
                others.append(i)
        size = np.zeros(len(pieces), np.int64)
        ids = _NONE
        if self.bare:
            whole = (_END.join(words[at : at + _TOGETHER]) + _END for at in range(0, len(words), _TOGETHER))
            spelt = [codecs.charmap_decode(x.encode("utf-8", "surrogateescape"), "strict", self.letters)[0] for x in whole]
            ids = np.concatenate([_NONE, *(np.array(x.ids, np.uint32) for x in self.bare(spelt, add_special_tokens=False))])
            ids = ids[ids != self.part]
            is_end = ids == self.end
            size = np.diff(np.flatnonzero(is_end), prepend=-1) - 1
            ids = ids[~is_end]
        if others:
            found = [np.array(x.ids, np.uint32) for x in self.batch([pieces[i] for i in others], add_special_tokens=False)]
            ids = np.insert(ids, np.repeat(np.cumsum(size)[others], [len(x) for x in found]), np.concatenate(found))
            size[others] = [len(x) for x in found]
        return ids, size


class Encoder:
    """Ids of texts by the tokenizers library. Of a byte-level vocabulary it is asked once for each distinct
    piece between white space; texts go to it whole with any other, or if they hold a special token's string."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(vocabulary(path))
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        split = t.pre_tokenizer
        self.by_piece = isinstance(t.model, models.BPE) and t.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        self.pieces = _Pieces(t) if self.by_piece else None

    @property
    def known(self) -> _Generation:
        """The pieces remembered."""
        return self.pieces.known

    @property
    def older(self) -> _Generation:
        """The pieces of the generation before."""
        return self.pieces.older

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [_NONE] * len(texts)
        waiting: list[int] = []
        size = 0

        def settle() -> None:
            for i, ids in zip(waiting, self.pieces.texts([texts[i] for i in waiting]), strict=True):
                out[i] = ids
            waiting.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            if waiting and size + len(text) > _WAIT:
                settle()
                size = 0
            waiting.append(i)
            size += len(text)
        if waiting:
            settle()
        return out


def _encoder(path: str | None) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _schema(kind: str) -> str:
    return f"part int, chunk int, first long, n_ids long, doc_ids array<{kind}>, n_tokens array<long>, coded binary"


def _write(path: str | None, end_id: int, id_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        part = TaskContext.get().partitionId()
        state = {"chunk": 0, "first": 0}
        docs: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [pa.array([part], pa.int32()), pa.array([state["chunk"]], pa.int32()), pa.array([state["first"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(id_type)), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([rangecoder.encode(ids)], pa.binary())]
            state["chunk"] += 1
            state["first"] += len(ids)
            return pa.RecordBatch.from_arrays(row, ["part", "chunk", "first", "n_ids", "doc_ids", "n_tokens", "coded"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                docs.append(doc)
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(held[-1])
                if size >= CHUNK_IDS:
                    yield close()
                    docs, held, size = [], [], 0
        if held:
            yield close()

    return run


def write_ids(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending id order.

    A null text is empty (its end id alone); null ids come first; rows of one id are in an order that
    their texts decide; an empty table gives a table without chunks. Extra columns are not read. Ids may
    be of any type that sorts.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(tasks_for(docs), "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    kind = rows.schema["id"].dataType
    rows.mapInArrow(_write(vocab, end_id, to_arrow_type(kind)), _schema(kind.simpleString())).write.parquet(out)


def _read(keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                part, first = row.column("part")[0].as_py(), row.column("first")[0].as_py()
                ids = rangecoder.decode(row.column("coded")[0].as_py())
                docs = row.column("doc_ids").flatten()
                n = row.column("n_tokens").flatten().to_numpy()
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
                columns = [pa.array([part] * len(n), pa.int32()), docs, pa.array(first + at[:-1]), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = ["part", "id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of every document, decoded from the files at ``path``.

    ``start`` counts the ids of all documents before it. ``keep_ids=False`` leaves out the ids. Files
    without a chunk give no rows; a damaged chunk fails the job.
    """
    chunks = spark.read.parquet(path)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"part int, id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = chunks.select("part", "first", "doc_ids", "n_tokens", "coded").mapInArrow(_read(keep_ids), schema)
    # one row per writing task: MAX_TASKS (16 bytes each) at most
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    out = rows.join(F.broadcast(starts), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")
    return out.withColumnRenamed("id", id_col)


def op1_token_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "token-ids")
    write_ids(docs, path)
    return read_ids(spark, path, keep_ids=False)
