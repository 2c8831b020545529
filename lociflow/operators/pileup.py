"""From variants and reads to one row per (variant, alternate allele, read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a position bin; a read is copied to each bin that it touches.
BIN = 1024


def mutant_samples(gts: Column) -> Column:
    """Samples whose genotype isn't exactly two reference alleles."""
    is_ref = lambda g: (F.size(g) == 2) & (F.coalesce(F.get(g, 0), F.lit(-1)) == 0) & (F.coalesce(F.get(g, 1), F.lit(-1)) == 0)
    return F.map_keys(F.map_filter(gts, lambda k, g: ~is_ref(g)))


def mutation_type(rlen: Column, alt: Column) -> Column:
    """SUB, DEL or INS; null if the lengths fit none."""
    n = F.length(alt)
    return F.when(rlen == n, F.lit("SUB")).when(n < rlen, F.lit("DEL")).when(rlen == 1, F.lit("INS"))


def parsable(alt: Column) -> Column:
    return alt.rlike(r"^[ACTGN*]*$")


def live_variants(variants: DataFrame) -> DataFrame:
    """Records that have alternate alleles and a mutant sample; others leave the output altogether."""
    kept = variants.filter((F.coalesce(F.size("alts"), F.lit(0)) > 0)).withColumn("mutants", mutant_samples(F.col("gts")))
    return kept.filter(F.size("mutants") > 0)


def alleles(variants: DataFrame) -> DataFrame:
    """One row per allele that can be tested: (variant_id, alt_idx, alt, mut_type, chrom, pos0, stop0, mutants).

    A record that names one allele twice fails the job when its rows are read.
    """
    once = F.when(F.size(F.array_distinct("alts")) < F.size("alts"), F.raise_error(F.concat(F.lit("duplicate alternate allele in record "), F.col("variant_id").cast("string"))).cast("array<string>")).otherwise(F.col("alts"))
    rows = variants.select("*", F.posexplode(once).alias("alt_idx", "alt"))
    rows = rows.withColumn("mut_type", mutation_type(F.col("rlen"), F.col("alt")))
    return rows.filter(parsable(F.col("alt")) & F.col("mut_type").isNotNull()).select("variant_id", "alt_idx", "alt", "mut_type", "chrom", "pos0", "stop0", "mutants")


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], point: str, low: str, high: str, width: int = BIN) -> DataFrame:
    """Rows of ``points`` and ``spans`` that agree on ``keys`` with ``low <= point < high``.

    An equi-join on (keys, bin) with a residual test, so it is hash-partitioned, and AQE can split a
    deep locus. A point has one bin, thus no pair comes twice. Empty spans match nothing.
    """
    b = "__bin"
    # outer, and no filter on the ends: Spark would repeat whatever makes them in filters before it, uncompiled if that is long
    cut = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
    left = points.withColumn(b, F.floor(F.col(point) / width))
    right = spans.withColumn(b, F.explode_outer(F.when(F.col(high) > F.col(low), cut)))
    joined = left.join(right, [b, *keys])
    inside = (F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))
    return joined.filter(F.coalesce(inside, F.lit(False))).drop(b)


def depth(points: DataFrame, spans: DataFrame, keys: list[str], point: str, low: str, high: str, sums: list[str], width: int = BIN) -> DataFrame:
    """What :func:`range_join` would pair with each place of a point, without the pairs.

    One row for each (``keys``, ``point``) that a span covers: ``n_points`` there, ``n_spans`` over it and
    the sum of each of ``sums`` (whole numbers of the spans) over those; a sum of nulls only is null. A span
    counts from its start (in later bins: from the bin's) to its end, so running sums over a bin's places
    give what covers each. Places are reduced before they move; the work grows with the rows, not the pairs.
    """
    b, last, at, side = "__bin", "__last", "__at", "__side"
    c = F.col
    whole = [*keys, b, at]
    n = lambda x: f"__n_{x}"
    spans = spans.dropna(subset=keys).withColumn(last, F.floor((c(high) - 1) / width))
    # outer: an inner one would test the sequence before it is made, thus make it twice; empty spans have no bin
    spans = spans.withColumn(b, F.explode_outer(F.when(c(high) > c(low), F.sequence(F.floor(c(low) / width), c(last)))))
    edges = F.array(F.greatest(c(low), c(b) * width), F.when(c(b) == c(last), c(high)))
    spans = spans.select("*", F.posexplode_outer(edges).alias(side, at)).filter(c(b).isNotNull() & c(at).isNotNull())
    signed = lambda x: F.when(c(side) == 0, x).otherwise(-x)
    value = lambda x: F.coalesce(c(x).cast("long"), F.lit(0))
    steps = spans.select(
        *whole, F.lit(0).cast("long").alias("n_points"), signed(F.lit(1).cast("long")).alias("n_spans"),
        *[signed(value(x)).alias(x) for x in sums], *[signed(c(x).isNotNull().cast("long")).alias(n(x)) for x in sums],
    )
    none = F.lit(0).cast("long")
    places = points.dropna(subset=[*keys, point]).select(
        *keys, F.floor(c(point) / width).alias(b), c(point).alias(at), F.lit(1).cast("long").alias("n_points"), none.alias("n_spans"), *[none.alias(x) for x in sums], *[none.alias(n(x)) for x in sums]
    )
    moving = ["n_spans", *sums, *[n(x) for x in sums]]
    reduced = places.union(steps).groupBy(*whole).agg(*[F.sum(x).alias(x) for x in ["n_points", *moving]])
    before = Window.partitionBy(*keys, b).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = reduced.select(*keys, c(at).alias(point), "n_points", *[F.sum(x).over(before).alias(x) for x in moving])
    covered = running.filter((c("n_points") > 0) & (c("n_spans") > 0))
    return covered.select(*keys, point, "n_points", "n_spans", *[F.when(c(n(x)) > 0, c(x)).alias(x) for x in sums])


def pileup(sites: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads of the mutant samples over each allele's first position, samples pooled."""
    wanted = sites.withColumn("sample", F.explode("mutants")).drop("mutants")
    return range_join(wanted, reads, ["chrom", "sample"], "pos0", "ref_start", "ref_end")
