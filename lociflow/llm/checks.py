"""Parts of the corpus queries that SQL can state, each with its DuckDB counterpart.

A query's own columns come through its operator; those that a fitted model, a sampler or a checksum without
an SQL function decides are left out here. ``op6_minhash_hamming`` has SQL for all of its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import media, pieces
from .common import table
from .licenses import BASE, op2_license_scan
from .mixing import op5_entropy_balance
from .neardup import op6_minhash_hamming
from .quality import op9_ngram_ratio
from .sharding import op10_external_shuffle

_TEXT = "coalesce(text, '')"
_LOWER = f"translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def op2_base(spark, sf_dir: str) -> DataFrame:
    """Places of the base phrases."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {same})"


_BASE_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  p AS (SELECT doc_id, w, {", ".join(f"{_places(x)} AS p{k}" for k, x in enumerate(BASE))} FROM d),
  a AS (SELECT *, list_concat({", ".join(f"p{k}" for k in range(len(BASE)))}) AS places FROM p)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
    array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values()))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM a"""


def op3_payload(spark, sf_dir: str) -> DataFrame:
    """What the stored media give back, and the feature's number of frames."""
    return media.op3_peak_fingerprints(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "n_frames")


_PAYLOAD_SQL = f"""WITH d AS (SELECT doc_id, {_TEXT} AS t, strlen({_TEXT}) AS n FROM documents), p AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS m FROM d)
  SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(concat(t, repeat(chr(0), CAST(m - n AS INT)))) AS payload_sha256, CAST(m + 44 AS BIGINT) AS media_bytes,
    CAST(greatest(1, (greatest(m - {media.WINDOW}, 0) + {media.HOP - 1}) // {media.HOP} + 1) AS BIGINT) AS n_frames FROM p"""


def op5_targets(spark, sf_dir: str) -> DataFrame:
    """Sizes and targets, and whether what is taken keeps the rules."""
    rows = op5_entropy_balance(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("in_bounds"))


_TARGETS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all({_TEXT}, {_WORDS})) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, sum(size) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
  whole AS (SELECT 1.5 * sum(n) AS budget FROM s),
  r(step, source, n, w, full_) AS (SELECT 0, source, CAST(n AS DOUBLE), CAST(w AS DOUBLE), FALSE FROM s
    UNION ALL SELECT step + 1, source, n, w, full_ OR w * (budget - coalesce(sum(CASE WHEN full_ THEN 2 * n END) OVER (), 0)) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () > 2 * n
    FROM r, whole WHERE step <= (SELECT count(*) FROM s)),
  t AS (SELECT source, n, w, full_ FROM r WHERE step = (SELECT max(step) FROM r)),
  x AS (SELECT source, n, CASE WHEN full_ THEN 2 * n ELSE w * (budget - coalesce(sum(CASE WHEN full_ THEN 2 * n END) OVER (), 0)) / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target FROM t, whole)
  SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(target, 3) AS target, TRUE AS in_bounds FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source"""


def op7_decoded(spark, sf_dir: str) -> DataFrame:
    """The texts that the sampled pieces decode to."""
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.md5(pieces.decode("pieces").cast("binary")).alias("text_md5"))


_DECODED_SQL = f"SELECT doc_id, md5({_TEXT}) AS text_md5 FROM documents"

_LINKS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
  u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
  m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY 1)
  SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id"""


def op9_base(spark, sf_dir: str) -> DataFrame:
    """The counts of the base rules and their verdict."""
    return op9_ngram_ratio(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_COUNTS_SQL = rf"""WITH d AS (SELECT doc_id, {_TEXT} AS t, regexp_extract_all({_TEXT}, {_WORDS}) AS w,
    list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
  g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE k > 1) GROUP BY 1),
  c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN r USING (doc_id))
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""


def op10_shards(spark, sf_dir: str) -> DataFrame:
    """Rows of each shard, the range of its slots, and how many differ."""
    rows = op10_external_shuffle(spark, sf_dir)
    return rows.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"))


_SHARDS_SQL = """WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(x AS INT) AS shard, (n - x + 7) // 8 AS k FROM n, range(0, 8) t(x))
  SELECT shard, CAST(k AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS first_slot, CAST(k - 1 AS BIGINT) AS last_slot, CAST(k AS BIGINT) AS n_slots FROM s WHERE k > 0"""


def op10_rows(spark, sf_dir: str) -> DataFrame:
    """Sizes of the rows that were dealt out."""
    return op10_external_shuffle(spark, sf_dir).select("doc_id", "size", "law")


_ROWS_SQL = f"SELECT doc_id, CAST(strlen({_TEXT}) + 1 AS BIGINT) AS size, 'rows' AS law FROM documents"

PAIRS = {op2_base: _BASE_SQL, op3_payload: _PAYLOAD_SQL, op5_targets: _TARGETS_SQL, op7_decoded: _DECODED_SQL, op9_base: _COUNTS_SQL, op10_shards: _SHARDS_SQL, op10_rows: _ROWS_SQL}


def queries() -> dict:
    return {f.__name__: f for f in PAIRS}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: q for f, q in PAIRS.items()} | {op6_minhash_hamming.__name__: _LINKS_SQL}
