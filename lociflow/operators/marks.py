"""Read marks. Each adds one boolean column; rows outside ``eligible`` are never marked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cigar as C
from ..functions import stats

# SAM flag bits that a testable read needs and must not have.
NEEDED, REFUSED, REVERSE = 3, 3852, 16

SUPPORT, OVERLAP, LOW_QUAL, DUPLICATE = "SUPPORTS-VAR", "IS-OVERLAPPING-READ2", "LOW-QUAL", "IS-STUTTER-DUP"


def column(mark: str) -> str:
    """The column that holds a mark."""
    return "mark_" + mark.lower().replace("-", "_")


def testable(flag: Column) -> Column:
    return (flag.bitwiseAND(NEEDED) == NEEDED) & (flag.bitwiseAND(REFUSED) == 0)


def alt_matches(seq: Column, at: Column, alt: Column) -> Column:
    return F.coalesce(F.substring(seq, (at + 1).cast("int"), F.length(alt)) == alt, F.lit(False))


def with_positions(reads: DataFrame) -> DataFrame:
    """Adds what several marks and tests need, computed once: steps, mut_qpos, mean quality, clips."""
    s = F.col("steps")
    out = reads.withColumn("steps", C.steps(F.col("cigar")))
    return out.select(
        "*",
        C.ref_to_query(s, F.col("ref_start"), F.col("pos0")).alias("mut_qpos"),
        stats.mean(F.col("quals")).alias("mean_qual"),
        F.length("seq").cast("long").alias("query_len"),
        C.clip_start(s).alias("qa_start"),
        (F.length("seq") - C.clip_end(s)).cast("long").alias("qa_end"),
    )


def supports(row_strict: bool = False) -> Column:
    """Whether the read carries the allele. ``row_strict``: missing fields fail the job."""
    c = F.col
    missing = c("ref_end").isNull() | c("seq").isNull() | c("quals").isNull() | c("cigar").isNull() | c("mc").isNull()
    n = F.length("alt").cast("long")
    m = c("mut_qpos")
    bases = m.isNotNull() & alt_matches(c("seq"), m, c("alt"))
    fits = m + n <= c("query_len")
    inserted = fits & (C.aligned_in(c("steps"), c("ref_start"), m + 1, m + n, "q") == 0)
    covered = F.greatest(F.lit(0), F.least(c("ref_end"), c("stop0") + 1) - F.greatest(c("ref_start"), c("pos0")))
    last = C.ref_to_query(c("steps"), c("ref_start"), c("stop0"))
    inner = C.aligned_in(c("steps"), c("ref_start"), c("pos0") + 1, c("stop0"), "r")
    deleted = (covered == c("stop0") - c("pos0") + 1) & (inner == 0) & m.isNotNull() & last.isNotNull()
    by_type = F.when(c("mut_type") == "SUB", bases).when(c("mut_type") == "INS", bases & inserted).when(c("mut_type") == "DEL", deleted).otherwise(False)
    by_type = F.coalesce(by_type, F.lit(False))
    usable = F.coalesce(testable(c("flag")), F.lit(False))
    if row_strict:
        why = F.concat(F.lit("read lacks an essential field: "), F.coalesce(c("qname"), F.lit("?")))
        return F.when(~usable, F.lit(False)).when(missing, F.raise_error(why).cast("boolean")).otherwise(by_type)
    return usable & ~missing & by_type


def low_quality(min_mapping: float, min_clip: float, min_base: float) -> Column:
    """Low mapping quality, low mean quality of the aligned part of a clipped read, or (substitutions)
    a low base quality at the allele."""
    c = F.col
    part = F.slice("quals", (c("qa_start") + 1).cast("int"), F.greatest(c("qa_end") - c("qa_start"), F.lit(0)).cast("int"))
    total = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    clipped = c("cigar").contains("S") & (total < F.lit(float(min_clip)) * F.size(part))
    window = F.slice("quals", (c("mut_qpos") + 1).cast("int"), F.length("alt"))
    bases = (c("mut_type") == "SUB") & F.exists(window, lambda q: q < min_base)
    return F.coalesce(c("mapq") < min_mapping, F.lit(False)) | F.coalesce(clipped, F.lit(False)) | F.coalesce(bases, F.lit(False))


def mark_overlap(rows: DataFrame, eligible: Column, keys: list[str], name: str = "qname", quality: str = "mean_qual", order: str = "read_ord", out: str = column(OVERLAP)) -> DataFrame:
    """Of the reads of one name, each later read against the first: the worse is marked, ties the later.

    A read that is there twice (same sample and place in the order) fails the job.
    """
    ok = eligible & F.col(name).isNotNull() & F.col(quality).isNotNull()
    rows = rows.withColumn("__ok", ok)
    group = Window.partitionBy(*keys, "__ok", name)
    ordered = group.orderBy(order)
    same = F.lag(order).over(ordered) == F.col(order)
    if "sample" in rows.columns:
        same = same & F.lag("sample").over(ordered).eqNullSafe(F.col("sample"))
    twice = F.raise_error(F.concat(F.lit("a read is there twice: "), F.col(name).cast("string"))).cast("int")
    number = F.when(F.col("__ok") & F.coalesce(same, F.lit(False)), twice).otherwise(F.row_number().over(ordered))
    rows = rows.select("*", number.alias("__rn"), F.first(quality).over(ordered).alias("__q1"))
    later = F.max(F.when(F.col("__rn") > 1, F.col(quality))).over(group)
    marked = F.when(F.col("__rn") > 1, F.col(quality) <= F.col("__q1")).otherwise(F.coalesce(later > F.col("__q1"), F.lit(False)))
    return rows.withColumn(out, F.col("__ok") & marked).drop("__ok", "__rn", "__q1")


def duplicate_marks(ends: list, quality: list[float], window: int, documented: bool) -> list[bool]:
    """Marks of one group's reads, given in order of their first end.

    Reads join the open pool if no end is further than ``window`` from any member's; the pool's
    range in each of the four dimensions tells. A closed pool of several reads keeps its best.
    By default the last pool stays open, and a pool after one of several reads starts with the
    last read marked there (under the new read's ends); ``documented`` does neither.
    """
    marks = [False] * len(ends)
    pool: list[int] = []
    low: list[int] = []
    high: list[int] = []

    def close() -> int | None:
        if len(pool) < 2:
            return None
        worst_first = sorted(pool, key=quality.__getitem__)
        for i in worst_first[:-1]:
            marks[i] = True
        return worst_first[-2]

    for i, e in enumerate(ends):
        if pool and all(max(h, x) - min(lo, x) <= window for lo, h, x in zip(low, high, e, strict=True)):
            pool.append(i)
            low = [min(a, x) for a, x in zip(low, e, strict=True)]
            high = [max(a, x) for a, x in zip(high, e, strict=True)]
            continue
        carried = close() if pool else None
        pool = [i if documented or carried is None else carried]
        low, high = list(e), list(e)
    if documented and pool:
        close()
    return marks


def _boundaries(columns: list[pa.Array]) -> np.ndarray:
    """Row numbers at which a new group of equal keys begins (but 0)."""
    change = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        x = c.to_numpy(zero_copy_only=False)
        change |= x[1:] != x[:-1]
    return np.flatnonzero(change) + 1


def mark_duplicates(rows: DataFrame, eligible: Column, keys: list[str], window: int, documented: bool = False, quality: str = "mean_qual", order: str = "read_ord", ends: str = "ends", out: str = column(DUPLICATE), partitioned: bool = False) -> DataFrame:
    """Reads of one fragment pool but the best, marked by one ordered pass over each (variant, allele).

    Rows are hash-partitioned by ``keys`` (``partitioned``: they already are) and sorted; a task streams
    over them and holds one group at a time, each row once. A window of -1 marks nothing.
    """
    if window < 0:
        return rows.withColumn(out, F.lit(False))
    ok = F.coalesce(eligible & F.col(ends).isNotNull() & F.col(quality).isNotNull(), F.lit(False))
    ready = rows.withColumn("__ok", ok).withColumn("__e0", F.get(ends, 0))
    ready = (ready if partitioned else ready.repartition(*keys)).sortWithinPartitions(*keys, "__e0", order)
    schema = T.StructType([*ready.schema.fields, T.StructField(out, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that is still open

        def group() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            good = np.flatnonzero(table.column("__ok").to_numpy())
            marks = np.zeros(len(table), bool)
            if len(good) > 1:
                some = table.select([ends, quality]).take(pa.array(good))
                marks[good] = duplicate_marks(some.column(ends).to_pylist(), some.column(quality).to_pylist(), window, documented)
            at = 0
            for batch in held:
                yield batch.append_column(out, pa.array(marks[at : at + len(batch)]))
                at += len(batch)

        mark = None
        for batch in batches:
            if not len(batch):
                continue
            cuts = [0, *_boundaries([batch.column(k) for k in keys]).tolist(), len(batch)]
            first = [batch.column(k)[0] for k in keys]
            if held and first != mark:
                yield from group()
                held.clear()
            # whole groups inside the batch are done in one go
            last = cuts[-2]
            if last:
                held.append(batch.slice(0, cuts[1]))
                yield from group()
                held.clear()
                if cuts[1] < last:
                    yield _marked_groups(batch.slice(cuts[1], last - cuts[1]), [c - cuts[1] for c in cuts[1:-1]], ends, quality, window, documented, out)
            held.append(batch.slice(last))
            mark = [batch.column(k)[len(batch) - 1] for k in keys]
        if held:
            yield from group()

    return ready.mapInArrow(run, schema).drop("__ok", "__e0")


def _marked_groups(batch: pa.RecordBatch, cuts: list[int], ends: str, quality: str, window: int, documented: bool, out: str) -> pa.RecordBatch:
    """``batch`` with the marks of its groups, which begin and end at ``cuts``."""
    good = np.flatnonzero(batch.column("__ok").to_numpy(zero_copy_only=False))
    some = pa.array(good)
    e, q = batch.column(ends).take(some).to_pylist(), batch.column(quality).take(some).to_pylist()
    marks = np.zeros(len(batch), bool)
    edges = np.searchsorted(good, cuts).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > 1:
            marks[good[a:b]] = duplicate_marks(e[a:b], q[a:b], window, documented)
    return batch.append_column(out, pa.array(marks))
