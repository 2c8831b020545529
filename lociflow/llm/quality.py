"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in SQL functions only.

Two multinomials over hashed word one- and two-grams are fitted: one on trusted documents (label
quality 1), one on the raw corpus. A document's score is the mean, over its n-grams, of
``log p_trusted - log p_raw``; one threshold on it decides, so every document is judged alike. The
threshold is what all but ``LOST`` of trusted documents reach that the model was not fitted on.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, col, drop_stored, fresh, stored

#: Hash buckets of the two multinomials, and the pseudo count of each.
BUCKETS, ALPHA = 1 << 14, 1.0
#: The trusted model is fitted on so many labelled documents at most (those of the smallest hash).
MAX_TRUSTED = 20_000
#: Part of the trusted documents kept back from the fit that may score less than the threshold.
LOST = 0.002
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def ngrams(w: Column) -> Column:
    """Buckets of the one- and two-grams of the words ``w``."""
    ones = F.transform(w, lambda x: _bucket(x))
    twos = F.slice(F.transform(w, lambda x, i: _bucket(x, F.get(w, i + 1))), F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    return F.concat(ones, twos)


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """(trusted_id, half) of trusted documents, ``limit`` at most: few enough to broadcast (12 bytes each).

    Those of half 0 are fitted on, those of half 1 give the threshold. Labels without an id are left out,
    an id with several labels is trusted if one of them is 1.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()
    half = F.pmod(F.xxhash64(F.lit(1), "trusted_id"), F.lit(2)).cast("int")
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(limit).withColumn("half", half)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ``weights``, the log ratio of each bucket in bucket order, and ``threshold``.

    Counts cover every document. Buckets are counted map-side first, so a shuffle carries at most
    ``BUCKETS`` rows from each task. Without trusted documents the weights are 0 and so is the threshold:
    the base rules alone decide.
    """
    trusted = stored(trusted_ids(labels), "trusted-ids")
    ids = F.broadcast(trusted)
    w = docs.select(col(id_col).alias("id"), words(col(text_col)).alias("w")).join(ids, F.col("id") == F.col("trusted_id"), "left")
    each = w.select(F.when(F.col("half") == 0, 1).otherwise(0).alias("good"), F.explode(ngrams(F.col("w"))).alias("b"))
    counts = each.groupBy("b").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").na.fill(0, ["n", "g"])
    whole = full.agg(
        F.sum("n").alias("all_n"),
        F.sum("g").alias("all_g"),
        F.array_sort(F.collect_list(F.struct("b", "n", "g"))).alias("cells"),  # BUCKETS entries, always
    )

    def ratio(c: Column) -> Column:
        good = (c.g + ALPHA) / (F.col("all_g") + ALPHA * BUCKETS)
        return F.log(good) - F.log((c.n + ALPHA) / (F.col("all_n") + ALPHA * BUCKETS))

    # with no trusted document there is no evidence either way
    weights = whole.select(F.when(F.col("all_g") > 0, F.transform("cells", ratio)).otherwise(F.transform("cells", lambda c: F.lit(0.0))).alias("weights"))
    weights = stored(weights, "quality-weights")
    held = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).join(F.broadcast(trusted.filter("half = 1")), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    at = judge(held, weights, 0.0).filter("not quality.base_failed").agg(F.percentile("quality.score", F.lit(LOST))).first()[0]
    model = stored(weights.withColumn("threshold", F.lit(float(min(at or 0.0, 0.0)))), "quality-model")
    drop_stored(weights)
    drop_stored(trusted)
    return model


def repeated_words(w: Column, sorted_windows: Column) -> Column:
    """Words in three-word windows that the text has twice or more. ``sorted_windows``: (hash, start)."""
    at = lambda x, j: F.coalesce(F.get(sorted_windows, j).h == x.h, F.lit(False))
    twice = F.filter(sorted_windows, lambda x, i: at(x, i - 1) | at(x, i + 1))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))


def judge(docs: DataFrame, model: DataFrame, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` (``quality_`` if taken) of counts, score and verdict.

    A null or empty text has no words: all counts 0, score 0, base_failed. Repeated rows get equal
    values; no row is dropped. Windows are compared by 64-bit hashes of their three words.
    """
    out, wc, sc = fresh(docs, "quality", "w", "s")
    text = col(text_col)
    w, s = F.col(wc), F.col(sc)
    base = docs.withColumn(wc, words(text))
    windows = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    base = base.withColumn(sc, F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))))
    # BUCKETS numbers, whatever the input: they go into the plan as one literal
    row = model.first()
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in row.weights])), "array<double>")
    least = row.threshold if threshold is None else threshold
    one = lambda x, i: F.get(table, _bucket(x)) + F.when(i + 1 < F.size(w), F.get(table, _bucket(x, F.get(w, i + 1)))).otherwise(0.0)
    total = F.aggregate(F.transform(w, one), F.lit(0.0), lambda a, x: a + x)
    n = F.size(w).cast("long")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # rows that a generator makes are computed once: a filter on them can't go below it, where it would
    # repeat the array work for every element
    counts = F.struct(
        n.alias("n_words"),
        F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(w, s).cast("long").alias("n_repeat_words"),
        F.when(n > 0, total / (2 * n - 1)).otherwise(0.0).alias("score"),
    )
    made = base.select(*[col(c) for c in docs.columns], F.explode(F.array(counts)).alias(wc))
    q = F.col(wc)
    failed = (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEAT_PERCENT * q.n_words)
    fields = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    verdict = F.struct(*fields, failed.alias("base_failed"), (~failed & (q.score >= least)).alias("kept"), q.score.alias("score"))
    return made.select(*[col(c) for c in docs.columns], verdict.alias(out))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    out = fresh(docs, "quality")[0]
    return judge(docs, fit(docs, labels)).filter(F.col(out).kept).select(*[col(c) for c in docs.columns])


def op9_ngram_ratio(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "quality.*")
