"""CIGAR arithmetic as column expressions: running cursors over the operations, no pair lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = r"(\d+)([MIDNSHP=X])"
MATCH, QUERY, REF = ("M", "=", "X"), ("M", "=", "X", "I", "S"), ("M", "=", "X", "D", "N")


def steps(cigar: Column) -> Column:
    """array<struct<op, n>>; null for a null or ``*`` CIGAR."""
    each = F.regexp_extract_all(cigar, F.lit(_STEP), F.lit(0))
    op = lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.left(x, F.length(x) - 1).cast("long").alias("n"))
    return F.when(cigar != "*", F.transform(each, op))


def problem(cigar: Column) -> Column:
    """Why a CIGAR can't be measured, or null. Digits after the last operation are ignored."""
    return (
        F.when(cigar.isNull() | (cigar == ""), F.lit("empty"))
        .when(cigar.rlike(r"[^0-9MIDNSHP=X]"), F.lit("unknown operation"))
        .when(cigar.rlike(r"(^|[MIDNSHP=X])[MIDNSHP=X]"), F.lit("operation without length"))
    )


def _is(x: Column, kinds) -> Column:
    """Whether a step's operation, always one letter, is among ``kinds``: one look-up where ``isin``
    would compare text after text in folds that Spark doesn't compile."""
    return F.lit("".join(kinds)).contains(x.op)


def _length(s: Column, kinds) -> Column:
    return F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.when(_is(x, kinds), x.n).otherwise(0))


def ref_end(cigar: Column, start: Column) -> Column:
    """End (exclusive) on the reference of a read that starts at ``start``; null if there is a problem."""
    sound = (cigar != "") & cigar.rlike(rf"^(?:{_STEP})*\d*$")
    return F.when(sound, start + _length(steps(cigar), REF))


def query_length(s: Column) -> Column:
    return _length(s, QUERY)


def clip_start(s: Column) -> Column:
    """Soft-clipped bases before the first aligned one."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("past"))
    step = lambda a, x: F.struct((a.n + F.when(~a.past & (x.op == "S"), x.n).otherwise(0)).alias("n"), (a.past | ~_is(x, ("S", "H"))).alias("past"))
    return F.aggregate(s, zero, step, lambda a: a.n)


def clip_end(s: Column) -> Column:
    return clip_start(F.reverse(s))


def ref_to_query(s: Column, start: Column, pos: Column) -> Column:
    """Index in the read of the base aligned to reference position ``pos``; null where it is deleted,
    skipped or not covered."""
    zero = F.struct(F.lit(0).cast("long").alias("q"), start.cast("long").alias("r"), F.lit(None).cast("long").alias("at"))

    def step(a: Column, x: Column) -> Column:
        here = (a.r <= pos) & (pos < a.r + x.n) & _is(x, MATCH)
        return F.struct(
            (a.q + F.when(_is(x, QUERY), x.n).otherwise(0)).alias("q"),
            (a.r + F.when(_is(x, REF), x.n).otherwise(0)).alias("r"),
            F.when(here, a.q + pos - a.r).otherwise(a["at"]).alias("at"),
        )

    return F.aggregate(s, zero, step, lambda a: a["at"])


def aligned_in(s: Column, start: Column, low: Column, high: Column, axis: str) -> Column:
    """Aligned bases whose reference (``axis='r'``) or query (``'q'``) position is in [low, high)."""
    zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("sum"))
    kinds = QUERY if axis == "q" else REF
    offset = F.lit(0) if axis == "q" else start

    def step(a: Column, x: Column) -> Column:
        at = a.c + offset
        part = F.greatest(F.lit(0), F.least(high, at + x.n) - F.greatest(low, at))
        return F.struct(
            (a.c + F.when(_is(x, kinds), x.n).otherwise(0)).alias("c"),
            (a["sum"] + F.when(_is(x, MATCH), part).otherwise(0)).cast("long").alias("sum"),
        )

    return F.aggregate(s, zero, step, lambda a: a["sum"])


def endpoints(ref_start: Column, end: Column, mate_start: Column, mate_end: Column) -> Column:
    """The fragment's four ends in ascending order."""
    return F.sort_array(F.array(*[c.cast("long") for c in (ref_start, end, mate_start, mate_end)]))
