"""The whole plan: variants and reads in, one result per (variant, allele, flag) out.

Two shuffles carry reads: the binned range join, and one by (variant, allele) that the window over
mates and the ordered pass share. The final aggregation combines inside the tasks that the second left,
so its own shuffle carries one row for each (variant, allele) and task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import info
from ..operators import flags as FL
from ..operators import marks as M
from ..operators import pileup as P
from . import config as K

KEYS = ["variant_id", "alt_idx"]
Tagger = Callable[[DataFrame, Column, dict], DataFrame]


@dataclass
class Registry:
    """Processes that a configuration may name. ``tagger`` and ``flagger`` extend it."""

    taggers: dict[str, Tagger] = field(default_factory=dict)
    flaggers: dict[str, FL.Flagger] = field(default_factory=dict)
    adds: dict[str, str] = field(default_factory=lambda: dict(K.ADDS))
    rules: dict[str, dict] = field(default_factory=lambda: dict(K.RULES))

    def tagger(self, name: str, adds: str, run: Tagger | Callable[[dict], Column], rules: dict | None = None) -> None:
        """``run(rows, eligible, params)`` adds the mark's column; or ``run(params)`` is its condition."""
        if name in self.taggers or name in self.flaggers or adds in self.adds.values():
            raise K.ConfigError(f"process or mark is taken: {name}, {adds}")
        self.taggers[name], self.adds[name], self.rules[name] = run, adds, rules or {}

    def flagger(self, name: str, test: FL.Flagger, rules: dict | None = None) -> None:
        if name in self.taggers or name in self.flaggers:
            raise K.ConfigError(f"process is taken: {name}")
        self.flaggers[name], self.rules[name] = test, rules or {}


def condition(build: Callable[[dict], Column], mark: str) -> Tagger:
    """A tagger from a row-local condition."""
    return lambda rows, eligible, params: rows.withColumn(M.column(mark), F.coalesce(eligible & build(params), F.lit(False)))


def builtin(dup_mode: str = "as_implemented", strict: bool = True) -> Registry:
    if dup_mode not in ("as_implemented", "as_documented"):
        raise K.ConfigError(f"dup_mode: {dup_mode}")
    out = Registry()
    out.taggers = {
        "mark-support": condition(lambda p: M.supports(strict), M.SUPPORT),
        "mark-overlap": lambda rows, ok, p: M.mark_overlap(rows, ok, KEYS),
        "mark-low-qual": condition(lambda p: M.low_quality(p["min_mapping_quality"], p["min_avg_clip_quality"], p["min_base_quality"]), M.LOW_QUAL),
        "mark-duplicates": lambda rows, ok, p: M.mark_duplicates(rows, ok, KEYS, p["duplication_window_size"], dup_mode == "as_documented", partitioned=True),
    }
    out.flaggers = {
        "LQF": FL.proportion((M.column(M.LOW_QUAL), M.column(M.DUPLICATE))),
        "DVF": FL.proportion((M.column(M.DUPLICATE),)),
        "ALF": FL.ALIGNMENT_SCORE,
        "ADF": FL.PLACEMENT,
    }
    return out


def predicate(required: list[str], excluded: list[str], columns: list[str]) -> Column:
    """Has all required and none of the excluded marks; a mark that nothing added is absent."""
    out = F.lit(True)
    for m in required:
        out = out & (F.col(M.column(m)) if M.column(m) in columns else F.lit(False))
    for m in excluded:
        if M.column(m) in columns:
            out = out & ~F.col(M.column(m))
    return out


def check_reads(rows: DataFrame) -> DataFrame:
    """Fails the job on tags of a wrong type (``AS`` neither i nor C; ``MC`` not Z, where the source says
    so), of reads that a variant touches."""
    bad = F.col("as_score").isNotNull() & ~F.col("as_type").isin("i", "C")
    rows = rows.withColumn("as_score", F.when(bad, F.raise_error(F.concat(F.lit("AS tag of type "), F.col("as_type"))).cast("int")).otherwise(F.col("as_score")))
    if "mc_type" in rows.columns:
        odd = M.testable(F.col("flag")) & (F.col("mc_type") != "Z")
        rows = rows.withColumn("mc", F.when(odd, F.raise_error(F.concat(F.lit("MC tag of type "), F.col("mc_type")))).otherwise(F.col("mc"))).drop("mc_type")
    return rows


def features(rows: DataFrame) -> DataFrame:
    """Adds what the marks and tests read; sequences are dropped by column pruning after the marks."""
    rows = M.with_positions(rows)
    c = F.col
    mate_end = C.ref_end(c("mc"), c("next_ref_start"))
    whole = mate_end.isNotNull() & c("ref_end").isNotNull() & c("quals").isNotNull()
    reverse = c("flag").bitwiseAND(M.REVERSE) > 0
    return rows.select(
        "*",
        F.when(whole, C.endpoints(c("ref_start"), c("ref_end"), c("next_ref_start"), mate_end)).alias("ends"),
        (c("as_score") / c("query_len")).alias("density"),
        reverse.alias("reverse"),
        (c("qa_end") - c("qa_start")).alias("aligned_len"),
        F.when(reverse, c("qa_end") - c("mut_qpos") + 1).otherwise(c("mut_qpos") - c("qa_start") + 1).alias("la2m"),
    )


#: What the built-in marks over groups and the built-in tests read, besides the marks.
NARROW = [*KEYS, "sample", "read_ord", "qname", "mean_qual", "ends", "density", "reverse", "aligned_len", "la2m"]


def marked_reads(variants: DataFrame, reads: DataFrame, config: dict[str, Any], registry: Registry | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame, list]:
    """(sites, rows, flag steps): alleles, their pileups with all marks, and the flags still to run."""
    registry = registry or builtin(strict=strict)
    steps = K.compile_exec(config, registry.adds, registry.rules, tuple(registry.flaggers))
    live = P.live_variants(variants)
    sites = P.alleles(live)
    # reads that can't support an allele matter to no process if all others require support
    only_support = all(M.SUPPORT in required for name, required, _ in steps if name != "mark-support")
    if only_support and any(name == "mark-support" for name, _, _ in steps):
        reads = reads.filter(M.testable(F.col("flag")))
    rows = features(check_reads(P.pileup(sites, reads)))
    own = set(registry.taggers) == set(K.ADDS) and set(registry.flaggers) == set(K.FLAGS)
    later, dealt = [], False
    for name, required, excluded in steps:
        passes = predicate(required, excluded, rows.columns)
        params = config["params"].get(name, {})
        if name not in registry.taggers:
            later.append((name, registry.flaggers[name], params, passes))
            continue
        if name not in ROW_LOCAL and not dealt:
            rows, dealt = rows.repartition(*KEYS), True
        rows = registry.taggers[name](rows, passes, params)
        # bases and qualities need not reach the window and the ordered pass
        if own and _row_local_done(name, steps):
            rows = rows.select([c for c in rows.columns if c in NARROW or c.startswith("mark_")])
    for mark in registry.adds.values():
        if M.column(mark) not in rows.columns:
            rows = rows.withColumn(M.column(mark), F.lit(False))
    later = [(n, t, p, predicate(*_marks(steps, n), rows.columns)) for n, t, p, _ in later]
    return sites, rows, later


#: Taggers that look at one read at a time.
ROW_LOCAL = ("mark-support", "mark-low-qual")


def _marks(steps: list, name: str) -> tuple[list[str], list[str]]:
    return next((r, e) for n, r, e in steps if n == name)


def _row_local_done(name: str, steps: list) -> bool:
    """Whether no process after ``name`` reads bases or qualities."""
    names = [s[0] for s in steps]
    return not set(ROW_LOCAL) & set(names[names.index(name) + 1 :])


def flag(variants: DataFrame, reads: DataFrame, config: dict[str, Any] | None = None, registry: Registry | None = None, dup_mode: str = "as_implemented", strict: bool = True) -> DataFrame:
    """(variant_id, alt_idx, alt, flag, outcome, info_bits, reads_seen, stat, extra, info).

    ``variants`` and ``reads`` have the schemas of :mod:`lociflow.schema`. Every testable allele of
    every live record has a row for each enabled flag, NA where it has no reads. ``strict``: a read that
    passes the flag-bit filter but lacks bases, qualities, CIGAR, reference end or ``MC`` fails the job;
    otherwise it doesn't support the allele.
    """
    config = config or K.default()
    registry = registry or builtin(dup_mode, strict)
    sites, rows, later = marked_reads(variants, reads, config, registry, strict)
    out = FL.run(sites.select(*KEYS, "alt"), rows, KEYS, later)
    return out.withColumn("info", info.render(F.col("alt"), F.col("outcome"), F.col("info_bits"), F.col("reads_seen"), F.col("extra")))


def records(variants: DataFrame, results: DataFrame) -> DataFrame:
    """One row per live record: its line's fields, ``failed`` (names of failing flags, sorted) and
    ``infos`` (flag to its alleles' values joined by commas in allele order)."""
    per_flag = results.groupBy("variant_id", "flag").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("alt_idx", "info"))), lambda x: x.info)).alias("value"),
        F.max((F.col("outcome") == "FAIL").cast("int")).alias("bad"),
    )
    per_record = per_flag.groupBy("variant_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("bad") == 1, F.col("flag")))).alias("failed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "value")))).alias("infos"),
    )
    return P.live_variants(variants).join(per_record, "variant_id", "left")


__all__ = ["KEYS", "Registry", "builtin", "condition", "features", "flag", "marked_reads", "predicate", "records"]
