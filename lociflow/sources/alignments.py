"""Aligned reads: SAM text, BAM, and Parquet in the engine's own schema."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from . import bam

COLUMNS = ["sample", "read_ord", "qname", "flag", "chrom", "ref_start", "ref_end", "mapq", "cigar", "next_ref_start", "seq", "quals", "mc", "as_score", "as_type", "mc_type"]


def sample_of(head: list[str]) -> str:
    """SM of the first read group."""
    for line in head:
        if line.startswith("@RG"):
            if m := re.search(r"\tSM:([^\t]*)", line):
                return m.group(1)
            break
    raise ValueError("the first read group names no sample")


def _finish(rows: DataFrame, sample: str, order: int) -> DataFrame:
    """``read_ord``: file order within the sample, samples in the order of ``order``."""
    end = C.ref_end(F.col("cigar"), F.col("ref_start"))
    return rows.withColumn("sample", F.lit(sample)).withColumn("read_ord", F.lit(order << 56) + F.col("read_ord")).withColumn("ref_end", end).select(*COLUMNS)


def _tag(fields: Column, name: str) -> Column:
    return F.get(F.filter(F.slice(fields, 12, F.greatest(F.size(fields) - 11, F.lit(0))), lambda t: t.startswith(f"{name}:")), 0)


def read_sam(spark: SparkSession, path: str, sample: str | None = None, order: int = 0) -> DataFrame:
    """A SAM text file. ``sample``: its name, the first read group's unless given."""
    if sample is None:
        sample = sample_of([r[0] for r in spark.read.text(path).filter(F.col("value").startswith("@RG")).limit(1).collect()])
    is_read = (F.col("value") != "") & ~F.col("value").rlike("^@[A-Z][A-Z]\t")
    lines = spark.read.text(path).filter(is_read)
    f = F.col("f")
    # Spark may test a field before that filter: a header line has no fields
    rows = lines.select(F.monotonically_increasing_id().alias("read_ord"), F.split(F.when(is_read, F.col("value")), "\t", -1).alias("f"))
    rows = rows.withColumn("mc_tag", _tag(f, "MC")).withColumn("as_tag", _tag(f, "AS"))
    star = lambda c: F.when(c != "*", c)
    as_type = F.substring("as_tag", 4, 1)
    mc = F.col("mc_tag")
    rows = rows.select(
        "read_ord",
        star(F.get(f, 0)).alias("qname"),
        F.get(f, 1).cast("int").alias("flag"),
        star(F.get(f, 2)).alias("chrom"),
        (F.get(f, 3).cast("long") - 1).alias("ref_start"),
        F.get(f, 4).cast("int").alias("mapq"),
        star(F.get(f, 5)).alias("cigar"),
        (F.get(f, 7).cast("long") - 1).alias("next_ref_start"),
        star(F.get(f, 9)).alias("seq"),
        F.when(F.get(f, 10) != "*", F.transform(F.split(F.get(f, 10), ""), lambda x: F.ascii(x) - 33)).alias("quals"),
        F.when(F.substring(mc, 4, 1) == "Z", F.substring(mc, 6, 1 << 30)).alias("mc"),
        F.substring(mc, 4, 1).alias("mc_type"),
        F.when(as_type.isin("i", "C"), F.substring("as_tag", 6, 20).cast("int")).when(F.col("as_tag").isNotNull(), F.lit(0)).alias("as_score"),
        as_type.alias("as_type"),
    )
    return _finish(rows, sample, order)


def _local(path: str) -> str | None:
    """The path that ``open`` takes, if the file is there."""
    name = path.removeprefix("file://")
    return name if os.path.isfile(name) else None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            yield from bam.records(io.BytesIO(content))


def _header_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([bam.header(io.BytesIO(c))[0] for c in batch.column(0).to_pylist()], pa.string())], ["text"])


def bam_header(spark: SparkSession, path: str) -> list[str]:
    """Header lines of a BAM file; only its first blocks are inflated."""
    if (name := _local(path)) is not None:
        with open(name, "rb") as f:
            return bam.header(f)[0].split("\n")
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_header_text, "text string").first()[0].split("\n")


def read_bam(spark: SparkSession, path: str, sample: str | None = None, order: int = 0, split_bytes: int = bam.SPLIT_BYTES) -> DataFrame:
    """A BAM file. One that can be opened by its path is read in the ranges of its index (:mod:`.bam`).

    One that only Spark can read is one task and 2 GB at most. Either way, keep what is read often as
    Parquet: that scan prunes by chrom and reads columns.
    """
    if sample is None:
        sample = sample_of(bam_header(spark, path))
    if (name := _local(path)) is not None:
        return _finish(bam.scan(spark, name, split_bytes), sample, order)
    files = spark.read.format("binaryFile").load(path).select("content")
    return _finish(files.mapInArrow(_decode, bam.DDL), sample, order)


def read_alignment(spark: SparkSession, path: str, sample: str | None = None, order: int = 0) -> DataFrame:
    """By suffix: .sam, .bam or .parquet. CRAM needs a reference decoder, which isn't there."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "sam":
        return read_sam(spark, path, sample, order)
    if kind == "bam":
        return read_bam(spark, path, sample, order)
    if kind == "parquet":
        rows = spark.read.parquet(path)
        return rows.withColumn("sample", F.lit(sample)) if sample else rows
    raise ValueError(f"{path}: alignments are .sam, .bam or .parquet files (CRAM is not supported)")


def match_samples(vcf_names: list[str], tags: dict[str, str], mapping: list[str] | dict[str, str] | None = None) -> dict[str, str]:
    """VCF sample to file, from ``tags`` (file to SM name) and an optional mapping.

    None: every SM name is a VCF sample. A list: exactly one of its names is in the VCF and takes the
    last file. A dict of VCF sample to SM name or file name: its values, all distinct, are together
    the SM names or else the file names.
    """
    if mapping is None:
        if odd := set(tags.values()) - set(vcf_names):
            raise ValueError(f"sample tags that the VCF lacks: {sorted(odd)}")
        return {sm: f for f, sm in tags.items()}
    if isinstance(mapping, list):
        hits = [n for n in mapping if n in vcf_names]
        if len(hits) != 1:
            raise ValueError(f"exactly one listed name must be in the VCF, not {hits}")
        return {hits[0]: list(tags)[-1]}
    if odd := set(mapping) - set(vcf_names):
        raise ValueError(f"mapped samples that the VCF lacks: {sorted(odd)}")
    if len(set(mapping.values())) < len(mapping):
        raise ValueError("a name is mapped to twice")
    by_tag = {sm: f for f, sm in tags.items()}
    by_file = {f.rstrip("/").rpartition("/")[2]: f for f in tags}
    for known in (by_tag, by_file):
        if set(mapping.values()) == set(known):
            return {s: known[v] for s, v in mapping.items()}
    raise ValueError("mapped names are neither the files' sample tags nor their names")
