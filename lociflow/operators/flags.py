"""Variant tests: conditional aggregates over the marked reads of each (variant, allele).

All tests of a plan share one ``groupBy``. A test gives ``outcome`` (PASS, FAIL, NA), ``info_bits``,
``reads_seen`` and ``extra`` (its statistic as text).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import info, stats

Columns = dict[str, Column]


@dataclass(frozen=True)
class Flagger:
    """``aggregates(passes, params)`` are computed in the shared groupBy under a prefix; ``result(params,
    get)`` turns them into outcome, info_bits, reads_seen and extra. ``derive`` lists steps of columns
    computed in between, each step from those before it. ``bits``: all reason bits that the test may set
    (0: any)."""

    aggregates: Callable[[Column, dict], Columns]
    result: Callable[[dict, Callable[[str], Column]], Columns]
    derive: Callable[[dict, Callable[[str], Column]], list[Columns]] = lambda params, get: []
    bits: int = 0


def proportion(marks: tuple[str, ...]) -> Flagger:
    """Share of reads with any of ``marks`` (columns), against a largest share and a least number without."""

    def aggregates(passes: Column, params: dict) -> Columns:
        marked = F.lit(False)
        for m in marks:
            marked = marked | F.coalesce(F.col(m), F.lit(False))
        return {"n": F.count_if(passes), "with": F.count_if(passes & marked)}

    def result(params: dict, get) -> Columns:
        n, w = get("n"), get("with")
        loss = w / n
        bits = F.when(loss > float(params["read_loss_threshold"]), 2).otherwise(0) + F.when(n - w < params["min_pass_reads"], 4).otherwise(0)
        none = n == 0
        return {
            "outcome": F.when(none, "NA").when(bits == 0, "PASS").otherwise("FAIL"),
            "info_bits": F.when(none, 1).when(bits == 0, 7).otherwise(bits),
            "reads_seen": n,
            "stat": F.when(~none, loss),
            "extra_na": F.lit("0"),
        }

    return Flagger(aggregates, result, bits=sum(info.PROPORTION_BITS.values()))


def _score_aggregates(passes: Column, params: dict) -> Columns:
    score = F.when(passes, F.col("density"))
    return {"n": F.count_if(passes), "n_as": F.count(score), "med": F.percentile(score, F.lit(0.5))}


def _score_result(params: dict, get) -> Columns:
    n, n_as, med = get("n"), get("n_as"), get("med")
    fail = med <= float(params["avg_AS_threshold"])
    return {
        "outcome": F.when(n_as == 0, "NA").when(fail, "FAIL").otherwise("PASS"),
        "info_bits": F.when(n == 0, 1).when(n_as == 0, 2).otherwise(4),
        "reads_seen": n,
        "stat": F.when(med != 0, med),
        "extra_na": F.lit("NA"),
    }


ALIGNMENT_SCORE = Flagger(_score_aggregates, _score_result, bits=sum(info.BITS["ALF"].values()))


def _place_aggregates(passes: Column, params: dict) -> Columns:
    out: Columns = {"n": F.count_if(passes)}
    near = F.col("la2m") / F.col("aligned_len") <= float(params["edge_definition"])
    for strand, on in (("f", ~F.col("reverse")), ("r", F.col("reverse"))):
        here = passes & on
        place = F.when(here, F.col("la2m").cast("long"))
        out[strand] = F.collect_list(place)  # a pileup's depth of longs, for the deviations
        out[f"{strand}_n"], out[f"{strand}_sum"], out[f"{strand}_squares"] = F.count(place), F.sum(place), F.sum(place * place)
        out[f"{strand}_near"] = F.count_if(here & near)
    return out


def _place_derive(params: dict, get) -> list[Columns]:
    sd = {"one": params["min_sd_one_strand"], "weak": params["min_sd_both_strand_weak"], "strong": params["min_sd_both_strand_strong"]}
    return [
        {f"{s}_med": stats.median(get(s)) for s in "fr"},
        {f"{s}_mad": stats.mad(get(s), get(f"{s}_med")) for s in "fr"} | {f"{s}_sd_{k}": stats.spread_over_sums(get(f"{s}_n"), get(f"{s}_sum"), get(f"{s}_squares"), v) for s in "fr" for k, v in sd.items()},
    ]


def _place_result(params: dict, get) -> Columns:
    low = params["low_n_supporting_reads_boundary"]
    n = get("n")
    near_f, near_r = get("f_near"), get("r_near")
    nf, nr = get("f_n"), get("r_n")
    many_f, many_r = nf > low, nr > low

    def spread(strand: str, kind: str, min_mad: float) -> Column:
        return F.coalesce(get(f"{strand}_mad") > float(min_mad), F.lit(False)) & get(f"{strand}_sd_{kind}")

    p = params
    edge_at = float(p["edge_clustering_threshold"])

    def one_strand(strand: str) -> tuple[Column, Column]:
        edge = get(f"{strand}_near") / get(f"{strand}_n") < edge_at
        dist = spread(strand, "one", p["min_MAD_one_strand"])
        bad = F.when(edge, 0).otherwise(4) + F.when(dist, 0).otherwise(8)
        return edge & dist, F.when(edge & dist, 12).otherwise(bad)

    f_ok, f_bits = one_strand("f")
    r_ok, r_bits = one_strand("r")
    edge = (near_f + near_r) / n < edge_at
    weak = [spread(s, "weak", p["min_MAD_both_strand_weak"]) for s in "fr"]
    strong = [spread(s, "strong", p["min_MAD_both_strand_strong"]) for s in "fr"]
    good = F.when(edge, 4).otherwise(0) + F.when(weak[0] & weak[1], 16).otherwise(0) + F.when(strong[0] | strong[1], 32).otherwise(0)
    b_ok, b_bits = good > 0, F.when(good > 0, good).otherwise(4 + 16 + 32)
    both = many_f & many_r
    ok = F.when(both, b_ok).when(many_f, f_ok).otherwise(r_ok)
    bits = F.when(both, b_bits).when(many_f, f_bits).otherwise(r_bits)
    enough = n - near_f - near_r > p["min_non_edge_reads"]
    few = ~many_f & ~many_r
    return {
        "outcome": F.when(few, "NA").when(ok & enough, "PASS").otherwise("FAIL"),
        "info_bits": F.when(n == 0, 1).when(few, 2).when(ok & enough, bits + 64 + 2 + 1).when(ok, 64).when(enough, bits).otherwise(bits + 64),
        "reads_seen": n,
        "text": F.when(both | few, "BOTH").when(many_f, "F").otherwise("R"),
    }


PLACEMENT = Flagger(_place_aggregates, _place_result, _place_derive, bits=sum(info.BITS["ADF"].values()))


def checked_bits(name: str, test: Flagger, bits: Column) -> Column:
    """``bits``; a result without a reason, or with one that the test doesn't have, fails the job."""
    wrong = F.coalesce(bits <= 0, F.lit(True))
    if test.bits:
        wrong = wrong | (bits.bitwiseAND(~test.bits) != 0)
    why = F.concat(F.lit(f"{name} gave reason bits that it can't have: "), F.coalesce(bits.cast("string"), F.lit("none")))
    return F.when(wrong, F.raise_error(why).cast("int")).otherwise(bits)


def run(sites: DataFrame, rows: DataFrame, keys: list[str], tests: list[tuple[str, Flagger, dict, Column]]) -> DataFrame:
    """One row per (keys, flag): results of all ``tests`` (name, flagger, params, passes).

    One aggregation; sites without reads stay, with empty aggregates.
    """
    aggs = [c.alias(f"{name}__{k}") for name, t, params, passes in tests for k, c in t.aggregates(F.coalesce(passes, F.lit(False)), params).items()]
    grouped = rows.groupBy(*keys).agg(*aggs)
    wide = sites.join(grouped, keys, "left")
    fills = {}
    for field in grouped.schema.fields:
        if field.name in keys:
            continue
        kind = field.dataType.simpleString()
        if kind in ("bigint", "int"):
            fills[field.name] = F.coalesce(F.col(field.name), F.lit(0).cast(kind))
        elif kind.startswith("array"):
            fills[field.name] = F.coalesce(F.col(field.name), F.array().cast(kind))
    wide = wide.withColumns(fills) if fills else wide
    results = []
    for name, t, params, _ in tests:
        for step in t.derive(params, lambda k, name=name: F.col(f"{name}__{k}")):
            wide = wide.withColumns({f"{name}__{k}": c for k, c in step.items()})
        r = t.result(params, lambda k, name=name: F.col(f"{name}__{k}"))
        results.append(
            F.struct(
                F.lit(name).alias("flag"),
                r["outcome"].alias("outcome"),
                checked_bits(name, t, r["info_bits"].cast("int")).alias("info_bits"),
                r["reads_seen"].cast("long").alias("reads_seen"),
                r.get("stat", F.lit(None).cast("double")).cast("double").alias("stat"),
                r.get("text", r.get("extra_na", F.lit(None))).cast("string").alias("text"),
            )
        )
    flat = wide.select(*[F.col(c) for c in sites.columns], F.explode(F.array(*results)).alias("r")).select(*sites.columns, "r.*")
    return flat.withColumn("extra", F.coalesce(stats.text3(F.col("stat")), F.col("text"))).drop("text")
