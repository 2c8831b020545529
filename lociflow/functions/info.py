"""INFO values of flags: rendering, parsing, and names of reason bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason bits of each flag, lowest first.
PROPORTION_BITS = {"NO_READS": 1, "THRESHOLD": 2, "MIN_PASS": 4}
BITS = {
    "LQF": PROPORTION_BITS,
    "DVF": PROPORTION_BITS,
    "ALF": {"NO_READS": 1, "INSUFFICIENT_AS_TAGS": 2, "ON_THRESHOLD": 4},
    "ADF": {
        "NO_READS": 1,
        "INSUFFICIENT_READS": 2,
        "EDGE_CLUSTERING": 4,
        "ONE_STRAND_DISTRIB": 8,
        "BOTH_STRAND_DISTRIB_BOTH": 16,
        "BOTH_STRAND_DISTRIB_ONE": 32,
        "MIN_NON_EDGE": 64,
    },
}


def render(alt: Column, outcome: Column, bits: Column, reads: Column, extra: Column) -> Column:
    """``alt|outcome|0xbits|reads|extra``."""
    return F.concat_ws("|", alt, outcome, F.concat(F.lit("0x"), F.lower(F.hex(bits))), reads.cast("string"), extra)


def bit_names(flag: Column, bits: Column) -> Column:
    """Names of the bits that are set; null for an unknown flag."""
    out = F.lit(None).cast("array<string>")
    for name, members in BITS.items():
        picked = F.filter(F.array(*[F.when(bits.bitwiseAND(v) > 0, F.lit(k)) for k, v in members.items()]), lambda x: x.isNotNull())
        out = F.when(flag == name, picked).otherwise(out)
    return out


def explain(text: Column) -> Column:
    """Struct (flag, alt, outcome, conditions, reads, extra) of ``FLAG=alt|outcome|0xbits|reads|extra``.

    Null if the text hasn't exactly one ``=``, lacks the extra field or names no known flag.
    """
    sides = F.split(text, "=", -1)
    fields = F.split(F.get(sides, 1), r"\|", -1)
    bits = F.conv(F.regexp_replace(F.get(fields, 2), "^0[xX]", ""), 16, 10).cast("int")
    flag = F.get(sides, 0)
    whole = F.struct(
        flag.alias("flag"),
        F.get(fields, 0).alias("alt"),
        F.get(fields, 1).alias("outcome"),
        bit_names(flag, bits).alias("conditions"),
        F.get(fields, 3).alias("reads"),
        F.get(fields, 4).alias("extra"),
    )
    return F.when((F.size(sides) == 2) & (F.size(fields) > 4) & flag.isin(*BITS), whole)
