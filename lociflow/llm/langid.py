"""Language identification with bit-sliced Bloom filters over character n-grams.

Slot ``s`` of the filter holds one bit per language, so the AND of a gram's slots is the set of all
languages that contain the gram. A text's hits per language, less the false positives that each
language's filling makes likely, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop_stored, fresh, stored

N = 4
#: log2 of the filter's slots: as many as make four for each gram of the language that has most, in these
#: bounds. More grams fill the filter further; the correction for false positives covers that.
MIN_SLOT_BITS, MAX_SLOT_BITS, ROOM = 16, 24, 4
#: About so many labelled documents of each language are learned from (chosen by hash of the id).
MAX_TRAIN = 4000
SEED = 11
#: Part of a text's grams that the best language must know for the pipeline to keep the text.
MIN_COVERAGE = 0.2
_CHUNK = 1 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the text's ``N``-grams of lower-case letters, other runs being one space.

    A text is framed by spaces; long texts come in chunks that overlap by ``N - 1`` characters.
    """
    letters = _letter_table()
    low, tail = text.lower(), np.array([32], np.uint32)
    for at in range(0, max(len(low), 1), _CHUNK):
        part = np.frombuffer(low[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = at + _CHUNK >= len(low)
        c = np.concatenate([tail, np.where(letters[part], part, 32), np.full(N - 2 if last else 0, 32, np.uint32)])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep].astype(np.uint64)
        if last and len(c) < N:
            c = np.concatenate([c, np.full(N - len(c), 32, np.uint64)])
        if len(c) >= N:
            n = len(c) - N + 1
            h = c[:n] * _MULT[0]
            for i in range(1, N):
                h = (h ^ (h >> np.uint64(29))) + c[i : i + n] * _MULT[i]
            h = (h ^ (h >> np.uint64(32))) * _MIX
            yield h ^ (h >> np.uint64(33))
        tail = c[-(N - 1) :].astype(np.uint32)


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64((1 << bits) - 1)
    return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)


@dataclass
class Filters:
    """``table[w, slot]``: bits of languages ``8 w`` to ``8 w + 7``; ``langs[0]`` is the most frequent.

    The AND of a gram's two slots has the bit of every language that has the gram in its sample, and by
    chance (``false_rate``) of others.
    """

    langs: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    @property
    def slot_bits(self) -> int:
        return self.table.shape[1].bit_length() - 1

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """(gram, language): whether the filter has the gram for the language."""
        a, b = _slots(h, self.slot_bits)
        return np.unpackbits((self.table[:, a] & self.table[:, b]).T, axis=1, bitorder="little")[:, : len(self.langs)].astype(bool)

    def hits(self, text: str) -> tuple[int, np.ndarray]:
        """Grams of the text, and how many of them the filter has for each language (popcounts by bit)."""
        n, out = 0, np.zeros(8 * len(self.table))
        for h in grams(text):
            n += len(h)
            a, b = _slots(h, self.slot_bits)
            for w, words in enumerate(self.table):
                out[8 * w : 8 * w + 8] += np.bincount(words[a] & words[b], minlength=256) @ _BITS
        return n, out[: len(self.langs)]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, coverage)."""
        if not text or not _has_letter(text) or not self.langs:
            return "und", 0.0, 0.0
        n, hits = self.hits(text)
        found = np.clip((hits - n * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(np.argmax(found))
        whole = float(found.sum())
        return self.langs[best], float(found[best]) / whole if whole > 0 else 0.0, min(1.0, float(found[best]) / max(n, 1))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def is_held_out(doc_id: Column) -> Column:
    """Documents never learned from; a null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for bit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(bit, []).extend(grams(text))
        for bit, found in by.items():
            g = np.unique(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), bit, np.int32)), pa.array(g)], ["bit", "gram"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from labelled documents that are not held out; a bounded sample for each language.

    Every label is learned, and every gram of its sample. Null texts, labels and ids are not learned from;
    without labelled documents there are no languages. The table is put together on the executors: the
    driver gets one row for each filled slot and eight languages.
    """
    lang = col(lang_col)
    usable = docs.filter(lang.isNotNull() & col(text_col).isNotNull() & ~is_held_out(col(id_col)))
    sizes = [(r[0], r[1]) for r in usable.groupBy(lang.cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").collect()]  # one row per label
    langs = [k for k, _ in sizes]
    if not langs:
        return Filters([], np.zeros((1, 1 << MIN_SLOT_BITS), np.uint8), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit(SEED), col(id_col)), F.lit(1 << 30))
    parts = docs.sparkSession.createDataFrame([(bit, k, min(1 << 30, (MAX_TRAIN << 30) // n)) for bit, (k, n) in enumerate(sizes)], "bit int, known string, below long")
    labelled = usable.select(lang.cast("string").alias("lang"), col(text_col).cast("string").alias("text"), draw.alias("draw"))
    sample = labelled.join(F.broadcast(parts), (F.col("lang") == F.col("known")) & (F.col("draw") < F.col("below"))).select("bit", "text")
    found = stored(sample.mapInArrow(_distinct_grams, "bit int, gram long").distinct(), "grams")
    most = max((r[1] for r in found.groupBy("bit").count().collect()), default=0)
    bits = min(max((ROOM * most - 1).bit_length(), MIN_SLOT_BITS), MAX_SLOT_BITS) if most else MIN_SLOT_BITS
    mask = F.lit((1 << bits) - 1)
    slots = F.array(F.col("gram").bitwiseAND(mask), F.shiftrightunsigned("gram", 32).bitwiseAND(mask))
    one = F.expr("shiftleft(1, bit % 8)")
    cells = found.select((F.col("bit") / 8).cast("int").alias("word"), F.explode(slots).alias("slot"), one.alias("one"))
    cells = cells.groupBy("word", "slot").agg(F.bit_or("one").cast("int").alias("bits")).toArrow()
    table = np.zeros((-(-len(langs) // 8), 1 << bits), np.uint8)
    table[cells.column("word").to_numpy(), cells.column("slot").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint8)
    drop_stored(found)
    fill = np.array([np.mean((table[i // 8] >> (i % 8)) & 1) for i in range(len(langs))])
    return Filters(langs, table, fill**2)


def _predictor(shared):
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.predict(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame(rows, columns=["pred", "score", "coverage"])

    predict.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return predict


def identify(docs: DataFrame, model: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``language`` (``language_`` if taken): pred, score, coverage.

    A null text, or one without letters, is ``und`` with score 0, as is every text if nothing could
    be learned. A text none of whose grams is known gets the most frequent language and score 0.
    Only the text is read; equal texts get equal values.
    """
    out = fresh(docs, "language")[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**MAX_SLOT_BITS bytes for each eight languages

    predict = F.pandas_udf(_predictor(shared), "pred string, score double, coverage double")
    return docs.withColumn(out, predict(col(text_col)))


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents with letters whose best language knows ``MIN_COVERAGE`` of their grams."""
    out = fresh(docs, "language")[0]
    model = train(docs)
    known = (F.col(out).pred != "und") & ((F.col(out).coverage >= MIN_COVERAGE) | F.lit(not model.langs))
    return identify(docs, model).filter(known).select(*[col(c) for c in docs.columns])


def op4_bloom_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("language.pred").alias("lang_pred"), "language.score", "language.coverage")
