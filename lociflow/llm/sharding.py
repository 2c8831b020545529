"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash into buckets that fit in memory. Pass two
Fisher-Yates shuffles each bucket and writes it. The buckets one after another are then one
uniformly shuffled sequence, which is dealt to the shards in turn. Rows of equal id and text are scattered
too, by their number among their like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, col, drop_stored, fresh, stored

N_SHARDS = 8
SEED = 20240611
#: Text bytes that one bucket aims at; a task holds one bucket at a time.
BUCKET_BYTES = 16 << 20
#: Tasks of the second pass at most; each goes through its buckets one after another.
MAX_TASKS = 20_000
#: Rows of equal id and text that are numbered together, about; kinds of them broadcast at most (16 bytes each).
RUN_ROWS, MAX_BROADCAST_ROWS = 8192, 1_000_000
#: Of a batch to and from Python, about (rows are whole); rows of a batch from Python at most.
BATCH_BYTES = 2 << 20
_OUT_ROWS = 2048


def _fisher_yates(seed: int, bucket: int, n: int) -> np.ndarray:
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # in place, Fisher-Yates
    return order


def _shuffle_buckets(seed: int, bucket_col: str, part_col: str, pos_col: str):
    """Each bucket shuffled, with the task's number and the row's place among the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, done = None, 0
        task = TaskContext.get().partitionId()

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal done
            # in one piece: each take from several would copy the whole bucket
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            order = _fisher_yates(seed, current, len(rows))
            step = min(_OUT_ROWS, max(1, len(rows) * BATCH_BYTES // max(1, rows.nbytes)))
            for at in range(0, len(order), step):
                part = rows.take(pa.array(order[at : at + step]))
                part = part.append_column(part_col, pa.array(np.full(len(part), task, np.int32)))
                pos = pa.array(np.arange(done, done + len(part)), pa.int64())
                done += len(part)
                yield from part.append_column(pos_col, pos).combine_chunks().to_batches()

        for batch in batches:
            buckets = batch.column(bucket_col).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and int(buckets[a]) != current:
                    yield from emit()
                current = int(buckets[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from emit()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def _apart(keyed: DataFrame, h: str, more: str) -> DataFrame:
    """``keyed`` with column ``more``: 0, 1, 2, ... among rows of equal ``h``.

    Rows that share their hash with no other (nearly all, as a rule) aren't moved. Others are numbered in
    runs of about ``RUN_ROWS``, whatever group they belong to, so no group is gathered in one task.
    """
    times = keyed.groupBy(h).agg(F.count("*").alias("rows_")).filter("rows_ > 1")
    times = stored(times, "repeated-rows")
    n = times.count()
    if not n:
        drop_stored(times)
        return keyed.withColumn(more, F.lit(0).cast("long"))
    times = F.broadcast(times) if n <= MAX_BROADCAST_ROWS else times
    salt, at = fresh(keyed, "salt", "salt_at")
    runs = F.ceil(F.coalesce(F.col("rows_"), F.lit(1)) / RUN_ROWS)
    salted = keyed.join(times, h, "left").withColumn(salt, F.when(F.col("rows_").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), runs)))
    salted = stored(salted.drop("rows_"), "salted-rows")
    many = salted.filter(F.col(salt).isNotNull())
    ahead = Window.partitionBy(h).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each run
    first = many.groupBy(h, salt).agg(F.count("*").alias(at)).withColumn(at, F.coalesce(F.sum(at).over(ahead), F.lit(0)))
    placed = many.join(first, [h, salt]).withColumn(more, F.row_number().over(Window.partitionBy(h, salt).orderBy(h)) - 1 + F.col(at)).drop(at)
    once = salted.filter(F.col(salt).isNull()).withColumn(more, F.lit(0).cast("long"))
    return once.unionByName(placed).drop(salt)


def external_shuffle(
    docs: DataFrame,
    n_shards: int = N_SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` in shuffled order, with ``shard`` and ``slot`` added.

    Row counts of the shards differ by one at most (law ``rows``) and slots run from 0 without
    gaps. The order depends on the ids, the texts, ``seed`` and ``bucket_bytes`` alone. A null text
    counts one byte; null ids and repeated rows are ordinary rows, dealt apart however many there are;
    an empty table gives an empty result. If ``docs`` has columns of the added names, the added ones
    get a trailing ``_``.
    """
    bucket, h, pos, part, more = fresh(docs, "bucket", "row_hash", "bucket_pos", "bucket_part", "row_more")
    shard, slot = fresh(docs, "shard", "slot")
    first, place = fresh(docs, "bucket_first", "place")
    text = col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))

    keyed = _apart(docs.withColumn(h, F.xxhash64(F.lit(seed), col(id_col), text)), h, more)
    keyed = keyed.withColumn(h, F.when(F.col(more) > 0, F.xxhash64(h, more)).otherwise(F.col(h))).drop(more)
    keyed = keyed.withColumn(bucket, F.pmod(F.col(h), F.lit(n_buckets)).cast("long"))
    # a task has many buckets if there are very many, and holds one at a time
    scattered = keyed.repartition(min(n_buckets, MAX_TASKS), F.col(bucket)).sortWithinPartitions(bucket, col(id_col), h)
    schema = T.StructType([*scattered.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(pos, T.LongType())])
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        rows = stored(scattered.mapInArrow(_shuffle_buckets(seed, bucket, part, pos), schema).drop(h, bucket), "shuffled")

    # one row for each task of the second pass: MAX_TASKS (16 bytes each) at most
    counts = rows.groupBy(part).agg(F.count("*").alias(first))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    return (
        rows.join(F.broadcast(starts), part)
        .withColumn(place, F.col(first) + F.col(pos))
        .withColumn(shard, F.pmod(F.col(place), F.lit(n_shards)).cast("int"))
        .withColumn(slot, F.floor(F.col(place) / n_shards).cast("long"))
        .drop(part, pos, first, place)
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Shuffle ``docs`` and write one folder per shard, rows in slot order within each file. An empty table
    gives no folder."""
    out = external_shuffle(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_external_shuffle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return external_shuffle(docs).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
