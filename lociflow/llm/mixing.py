"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r >= 0 (its expected copies). Among all rates that give each source its
target number of words, the one nearest to "every document once" in relative entropy, with no rate
above ``cap``, is ``r = min(cap, exp(lam[source] * size / scale[source]))``. ``lam`` maximises a
concave dual (one variable per source); Newton steps on it, kept inside a bracket, are made on
a Spark table of counts per (source, size). Rates are then rounded to copies so that each source's
words stay within about its smallest fractional document of the target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, drop_stored, fresh, stored, word_count

BUDGET, CAP, WEIGHTS, SEED = 1.5, 2, (5, 2, 1), 97
#: Documents of one (source, size) class that one window partition ranks, about.
CLASS_ROWS = 8192
#: Classes whose plan is broadcast at most (about 60 bytes each).
MAX_BROADCAST_CLASSES = 1_000_000
MAX_STEPS, TOLERANCE = 60, 1e-7


def _source_key(source: Column) -> Column:
    """A key that is never null and sorts as the sources do: by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, budget: float = BUDGET, cap: float = CAP, weights=WEIGHTS) -> DataFrame:
    """(src, source_size, target) from (src, source_size): weighted shares of ``budget`` times all
    words, held at ``cap`` times a source's own, what is over being shared again by weight.

    The result is ``min(cap * size, level * weight)`` with the level at which the targets add up.
    One row per source goes through the windows, never documents: a million sources are 40 MB in one
    task. Sources without words have target 0; no sources, no rows.
    """
    order = Window.orderBy("src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "src")
    everything = Window.partitionBy()
    level = (
        F.lit(float(budget)) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    stepped = ranked.withColumn("level", level)
    # the first source, in order of cap per weight, that its level leaves below the cap
    at = F.min(F.when(F.col("level") < F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "src", "level"))).over(everything)
    return stepped.withColumn("at", at).select(
        "src",
        "source_size",
        F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("at.level") * F.col("w"))).alias("target"),
    )


def _rate(cap: float) -> Column:
    x = F.col("lam") * F.col("size") / F.col("scale")
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(x, F.lit(50.0)))))


def solve_rates(classes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(src, lam, scale, full, ...) by safeguarded Newton steps on the dual.

    ``classes`` is (src, size, n). Gradient and curvature of a source are sums over its classes.
    Sources whose target is their cap are ``full``: every document at the cap.
    """
    grouped = classes.groupBy("src").agg(F.sum("n").alias("n_docs"))
    state = targets.join(grouped, "src").select(
        "src",
        "source_size",
        "target",
        F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)).alias("scale"),
        (F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("lam"),
        F.lit(-1e6).alias("lo"),
        F.lit(1e6).alias("hi"),
        F.lit(float("inf")).alias("err"),
    )
    state = stored(state, "mix-state")
    for _ in range(MAX_STEPS):
        r = _rate(cap)
        at = classes.join(state, "src").withColumn("r", r)
        tokens = F.col("n") * F.col("size")
        curved = F.when(F.col("r") < cap, F.col("r")).otherwise(F.lit(0.0)) * tokens * F.col("size") / F.col("scale")
        keys = ["src", "source_size", "target", "scale", "full", "lam", "lo", "hi"]
        sums = at.groupBy(*keys).agg(F.sum(tokens * F.col("r")).alias("got"), F.sum(curved).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        # an open bracket is widened by doubling instead of halved
        half = F.when(F.col("lo") <= -1e6, F.least(F.lit(-1.0), 2 * F.col("hi"))).when(F.col("hi") >= 1e6, F.greatest(F.lit(1.0), 2 * F.col("lo"))).otherwise((F.col("lo") + F.col("hi")) / 2)
        ok = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= 4 + F.abs(F.col("lam")))
        err = F.when(F.col("full") | (F.col("target") <= 0), F.lit(0.0)).otherwise(F.abs(gap) / F.col("target"))
        done = F.col("err") <= TOLERANCE
        step = (
            sums.withColumn("err", err)
            .withColumn("lo", lo)
            .withColumn("hi", hi)
            .withColumn("lam", F.when(done, F.col("lam")).when(ok, newton).otherwise(half))
            .select(*state.columns)
        )
        old, state = state, stored(step, "mix-state")
        worst = state.agg(F.max("err")).first()[0]
        drop_stored(old)
        if worst is None or worst <= TOLERANCE:
            break
    return state


def _round_source(cap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies of one source's size classes, largest first, carrying the rounding error on."""
        pdf = pdf.sort_values("size", ascending=False)
        n, size, rate = (pdf[c].to_numpy() for c in ("n", "size", "rate"))
        base = np.minimum(np.floor(rate), cap).astype(np.int64)
        extra = np.zeros(len(n), np.int64)
        carried = 0.0  # words wanted so far and not given
        for i in range(len(n)):
            if size[i] == 0:
                continue
            wanted = carried + (rate[i] - base[i]) * n[i] * size[i]
            room = n[i] if base[i] < cap else 0
            extra[i] = min(max(int(np.floor(wanted / size[i] + 0.5)), 0), room)
            carried = wanted - extra[i] * size[i]
        return pd.DataFrame({"src": pdf["src"].to_numpy(), "size": size, "n": n, "base": base, "extra": extra})

    return run


def plan_mix(sized: DataFrame, budget: float = BUDGET, cap: int = CAP, weights=WEIGHTS) -> DataFrame:
    """Copies for each class: (src, size, part, n_parts, base, limit, source_size, target).

    ``sized`` is (src, size, pick) with ``pick`` a uniform hash of the row; it must be cheap to read
    again. A document of the class and part gets ``base`` copies, and one more if its ``pick`` is not
    above ``limit``. Classes of many documents are ranked in parts, so no task gets a hot class. Size 0
    is a class like the others, with a rate of 1 unless its source is full; an empty table gives no rows.
    """
    classes = stored(sized.groupBy("src", "size").agg(F.count("*").alias("n")), "mix-classes")
    targets = source_targets(classes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), budget, cap, weights)
    state = solve_rates(classes, targets, cap)
    rated = classes.join(state, "src").select("src", "size", "n", _rate(cap).alias("rate"))
    # one row per distinct size of a source: W words allow sqrt(2 W) distinct sizes at most
    rounded = stored(rated.groupBy("src").applyInPandas(_round_source(cap), "src string, size long, n long, base long, extra long"), "mix-rounded")
    parts = rounded.withColumn("n_parts", F.ceil(F.col("n") / CLASS_ROWS).cast("long"))
    marked = sized.join(parts, ["src", "size"]).withColumn("part", F.pmod(F.xxhash64("pick"), F.col("n_parts")))
    keys = ["src", "size", "part"]
    in_part = Window.partitionBy(*keys)
    # each part picks its share of the class's extra copies
    share = F.round(F.col("extra") * F.count("*").over(in_part) / F.col("n"))
    ranked = marked.withColumn("share", share).withColumn("rank", F.row_number().over(in_part.orderBy("pick")))
    limits = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") <= F.col("share"), F.col("pick"))).alias("limit"),
        F.first("base").alias("base"),
        F.first("n_parts").alias("n_parts"),
    )
    return limits.join(state.select("src", "source_size", "target"), "src")


def _apply(rows: DataFrame, plan: DataFrame, parts: str = "n_parts") -> DataFrame:
    """``rows`` (which may carry texts) with their class's share of ``plan``, a stored table.

    Up to ``MAX_BROADCAST_CLASSES`` of its rows are broadcast, so ``rows`` aren't moved; beyond that a hot
    class is a skewed key of an inner join, which adaptive execution splits.
    """
    near = F.broadcast if plan.count() <= MAX_BROADCAST_CLASSES else lambda x: x
    joined = rows.join(near(plan.select("src", "size", parts).distinct()), ["src", "size"]).withColumn("part", F.pmod(F.xxhash64("pick"), F.col(parts)))
    joined = joined.drop(parts).join(near(plan.drop(parts)), ["src", "size", "part"])
    more = F.when(F.col("pick") <= F.col("limit"), 1).otherwise(0)
    return joined.withColumn("copies", (F.col("base") + more).cast("int"))


def _sized(docs: DataFrame, *more: Column, source_col="source", text_col="text", id_col="doc_id", seed: int = SEED) -> DataFrame:
    return docs.select(*more, _source_key(col(source_col)).alias("src"), word_count(col(text_col)).alias("size"), F.xxhash64(F.lit(seed), col(id_col), col(text_col)).alias("pick"))


def mix(docs: DataFrame, budget: float = BUDGET, cap: int = CAP, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0 to ``cap`` times).

    Null texts and texts without words have size 0 and no part in the targets; they keep a rate of
    1 and so appear once, unless their source is full (``cap`` times). A null source is one source,
    the last in order. Rows with equal id and text get equal copies. All columns are kept.
    """
    names = fresh(docs, "mix_row", "mix_copy")
    sized = stored(_sized(docs, seed=seed), "mix-sized")
    plan = stored(plan_mix(sized, budget, cap, weights), "mix-plan")
    rows = _sized(docs, F.struct(*[col(c) for c in docs.columns]).alias(names[0]), seed=seed)
    return _apply(rows, plan).withColumn(names[1], F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*[F.col(names[0]).getField(c).alias(c) for c in docs.columns])


def op5_entropy_balance(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = stored(_sized(docs, F.col("doc_id")), "mix-sized")
    plan = stored(plan_mix(sized.drop("doc_id")), "mix-plan")
    return _apply(sized, plan).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
