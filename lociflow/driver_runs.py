"""Whole runs of the engine on the driver's tables: records, aligned reads, files and configurations.

``part`` gives the records and ``lineitem`` the reads: each read has bases, qualities and a CIGAR of one of
four shapes, so every kind of allele is supported by some reads and not by others. The SQL twins know the
shapes and compute the places by arithmetic, never by CIGAR.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import cigar as C
from .plans import config as K
from .plans import engine as E
from .sources import alignments as A
from .sources import vcf

#: Bases of a read, and the largest distance of its start from the record's place.
LENGTH, REACH = 30, 34


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- records ------------------------------------------------------------------------------------

_REF = "CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'CCC' WHEN 2 THEN 'C' ELSE 'CC' END"
_ALT = "CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'CAG' ELSE 'CA' END"
_SECOND = "CASE WHEN p_partkey % 17 = 0 THEN ',<X>' WHEN p_size % 3 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN ',T' WHEN 1 THEN ',CC' WHEN 2 THEN ',CTG' ELSE ',CT' END ELSE '' END"
_ALTS = f"CASE WHEN p_partkey % 13 = 0 THEN '.' ELSE concat({_ALT}, {_SECOND}) END"
_GT0 = "CASE WHEN p_partkey % 11 = 0 THEN '0/0' WHEN p_partkey % 7 = 0 THEN './.' ELSE '0/1' END"
_GT1 = "CASE WHEN p_partkey % 11 = 0 OR p_size % 2 = 0 THEN '0|0' ELSE '1' END"
_FILTER = "CASE p_size % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'q10' ELSE '.' END"
_POS = "p_partkey * 1000 + 501"
_LINE = f"concat_ws(chr(9), 'c1', CAST({_POS} AS STRING), concat('rs', p_partkey), {_REF}, {_ALTS}, '.', {_FILTER}, concat('DP=', p_size), 'X:GT', concat('1:', {_GT0}), concat('2:', {_GT1}))"
HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=c1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS0\tS1"]


def _sql(expression: str) -> str:
    """The expression for DuckDB, which names some types and functions otherwise."""
    return expression.replace("AS STRING", "AS VARCHAR")


def vcf_file(spark: SparkSession, sf_dir: str) -> str:
    """``part`` as a VCF file; its records are in no order of their own."""
    out = scratch.path(spark, "records")
    lines = table(spark, sf_dir, "part").select(F.expr(_LINE).alias("value"))
    lines.union(spark.createDataFrame([("\n".join(HEAD),)], "value string")).write.text(out)
    return out


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the VCF file, numbered by part."""
    rows = vcf.read_vcf(spark, vcf_file(spark, sf_dir))
    return rows.withColumn("variant_id", F.substring("id", 3, 20).cast("long"))


_RECORDS = f"""rec AS (SELECT p_partkey AS v, {_POS} - 1 AS pos0, {_REF} AS ref, {_ALT} AS alt1, substr({_SECOND}, 2) AS alt2,
    p_partkey % 13 = 0 AS no_alt, {_GT0} <> '0/0' AS m0, {_GT1} <> '0|0' AS m1, p_size, {_sql(_LINE)} AS line FROM part),
  live AS (SELECT * FROM rec WHERE NOT no_alt AND (m0 OR m1)),
  allele AS (SELECT v, pos0, 0 AS alt_idx, ref, alt1 AS alt, m0, m1 FROM live
    UNION ALL SELECT v, pos0, 1, ref, alt2, m0, m1 FROM live WHERE alt2 <> '' AND alt2 <> '<X>')"""


def vcf_scan(spark, sf_dir):
    rows = vcf.read_vcf(spark, vcf_file(spark, sf_dir))
    gt = lambda s: F.concat_ws(",", F.transform(F.col("gts")[s], lambda a: F.coalesce(a.cast("string"), F.lit("."))))
    return rows.select("chrom", "pos0", "stop0", "rlen", "id", "ref", F.array_join("alts", ",").alias("alts"), "qual", "filter", "info", gt("S0").alias("s0"), gt("S1").alias("s1"), "record_line")


_VCF_SCAN_SQL = f"""SELECT 'c1' AS chrom, CAST({_POS} - 1 AS BIGINT) AS pos0, CAST({_POS} - 1 + length({_REF}) AS BIGINT) AS stop0, CAST(length({_REF}) AS INT) AS rlen,
    concat('rs', p_partkey) AS id, {_REF} AS ref, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE {_ALTS} END AS alts, '.' AS qual, {_FILTER} AS filter, concat('DP=', p_size) AS info,
    replace({_GT0}, '/', ',') AS s0, replace({_GT1}, '|', ',') AS s1, {_sql(_LINE)} AS record_line FROM part"""


# --- reads --------------------------------------------------------------------------------------

#: Start, shape, and the place in the read that meets the record's place if the read has no gap before.
_K = f"CAST((l_orderkey * 5 + l_linenumber * 7 + l_suppkey) % {REACH} AS INT) - 2"
_SHAPE = "CASE WHEN l_linenumber % 4 = 1 THEN 1 WHEN l_linenumber % 4 = 2 AND k >= 0 AND k <= 26 THEN 2 WHEN l_linenumber % 4 = 3 AND k >= 0 AND k <= 26 THEN 3 ELSE 0 END"
_CIGAR = "CASE shape WHEN 1 THEN '4S26M' WHEN 2 THEN concat(k + 1, 'M2D', 29 - k, 'M') WHEN 3 THEN concat(k + 1, 'M2I', 27 - k, 'M') ELSE '30M' END"
_BASES = "CASE WHEN l_linestatus = 'O' THEN CASE l_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'CAG' ELSE 'CA' END ELSE CASE l_partkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'G' WHEN 2 THEN 'CTG' ELSE 'CT' END END"
_AT = "greatest(0, least(27, k + CASE WHEN shape = 1 THEN 4 ELSE 0 END))"
_FLAG = "67 + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_suppkey % 9 = 0 THEN 1024 ELSE 0 END"
_ROW = "l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.expr(_K)).withColumn("shape", F.expr(_SHAPE)).withColumn("b", F.expr(_BASES))
    start = F.expr("l_partkey * 1000 + 500 - k")
    rows = li.select(
        F.expr("concat('S', l_suppkey % 2)").alias("sample"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("read_ord"),
        F.expr("concat('r', l_orderkey, '_', l_linenumber, '_', l_suppkey, '_', l_extendedprice)").alias("qname"),
        F.expr(f"CAST({_FLAG} AS INT)").alias("flag"),
        F.lit("c1").alias("chrom"),
        start.alias("ref_start"),
        F.expr("CAST(l_quantity AS INT)").alias("mapq"),
        F.expr(_CIGAR).alias("cigar"),
        (start + F.expr("l_suppkey % 5")).alias("next_ref_start"),
        F.expr(f"concat(repeat('C', {_AT}), b, repeat('C', {LENGTH} - {_AT} - length(b)))").alias("seq"),
        F.expr(f"transform(sequence(0, {LENGTH - 1}), i -> CAST((l_orderkey + i * l_linenumber) % 20 + 22 AS INT))").alias("quals"),
        F.lit("30M").alias("mc"),
        F.expr("CAST(25 + l_linenumber AS INT)").alias("as_score"),
        F.lit("i").alias("as_type"),
    )
    return rows.withColumn("ref_end", C.ref_end(F.col("cigar"), F.col("ref_start")))


# q: place of the read that is aligned to the record's, null if none; the read covers it if 0 <= k < span
_READS = f"""li AS (SELECT *, {_K} AS k FROM lineitem), sh AS (SELECT *, {_SHAPE} AS shape, {_BASES} AS b FROM li),
  rd AS (SELECT *, {_AT} AS at0, l_suppkey % 2 AS sample, {_FLAG} AS flag, CAST(floor(l_quantity) AS INT) AS mapq,
    CASE shape WHEN 1 THEN 26 WHEN 2 THEN 32 WHEN 3 THEN 28 ELSE 30 END AS span, CASE WHEN shape = 1 THEN 4 ELSE 0 END AS clip,
    list_transform(range(0, {LENGTH}), lambda i: (l_orderkey + i * l_linenumber) % 20 + 22) AS quals FROM sh),
  rs AS (SELECT *, concat(repeat('C', at0), b, repeat('C', CAST({LENGTH} - at0 - length(b) AS INT))) AS seq FROM rd),
  pile AS (SELECT a.v, a.alt_idx, a.ref, a.alt, a.pos0, r.*, k + clip AS q FROM allele a JOIN rs r ON r.l_partkey = a.v
    AND k >= 0 AND k < span AND ((sample = 0 AND m0) OR (sample = 1 AND m1))),
  marked AS (SELECT *, (flag & 3) = 3 AND (flag & 3852) = 0 AND CASE
      WHEN length(ref) = length(alt) THEN substr(seq, q + 1, length(alt)) = alt
      WHEN length(alt) < length(ref) THEN length(ref) = 3 AND shape = 2
      ELSE substr(seq, q + 1, length(alt)) = alt AND shape = 3 AND q + length(alt) <= {LENGTH} END AS supports,
    mapq < 11 OR (shape = 1 AND list_sum(quals[5:30]) < 35 * 26) OR (length(ref) = length(alt) AND list_min(quals[q + 1:q + length(alt)]) < 25) AS low,
    CASE WHEN l_returnflag = 'R' THEN {LENGTH} - q + 1 ELSE q - clip + 1 END AS la2m, (25 + l_linenumber) / {LENGTH}.0 AS density FROM pile)"""


def _config(*names: str) -> dict:
    """The named processes of the default graph; marks that none of them adds are not asked for."""
    out = K.default()
    made = {K.ADDS[n] for n in names if n in K.ADDS}
    for n, entry in out["exec"].items():
        if n != "opts":
            entry["enable"] = n in names
            entry["exclude-marks"] = [m for m in entry["exclude-marks"] if m in made]
    return out


def run_marks(spark, sf_dir):
    """Reads over each allele: support and quality marks, and the numbers that the tests read."""
    _, rows, _ = E.marked_reads(variants(spark, sf_dir), reads(spark, sf_dir), _config("mark-support", "mark-low-qual", "LQF"))
    supports, low = F.col("mark_supports_var"), F.col("mark_low_qual")
    each = rows.groupBy("variant_id", "alt_idx").agg(
        F.count_if(supports).alias("n_support"),
        F.count_if(low).alias("n_low"),
        F.sum(F.when(supports, F.col("la2m"))).alias("sum_la2m"),
        F.sum(F.when(supports, F.col("aligned_len"))).alias("sum_aligned"),
        F.sum(F.when(supports, F.round(F.col("mean_qual") * LENGTH))).cast("long").alias("sum_quality"),
        F.sum(F.when(supports, F.round(F.col("density") * LENGTH))).cast("long").alias("sum_score"),
        F.sum(F.when(supports, F.get("ends", 0) + 3 * F.get("ends", 3))).alias("sum_ends"),
    )
    return each


_RUN_MARKS_SQL = f"""WITH {_RECORDS}, {_READS}, m AS (SELECT *, pos0 - k AS s, CASE WHEN supports THEN low ELSE FALSE END AS low2 FROM marked WHERE (flag & 3852) = 0)
  SELECT v AS variant_id, CAST(alt_idx AS INT) AS alt_idx, CAST(count(*) FILTER (supports) AS BIGINT) AS n_support, CAST(count(*) FILTER (low2) AS BIGINT) AS n_low,
    CAST(sum(la2m) FILTER (supports) AS BIGINT) AS sum_la2m, CAST(sum({LENGTH} - clip) FILTER (supports) AS BIGINT) AS sum_aligned,
    CAST(sum(list_sum(quals)) FILTER (supports) AS BIGINT) AS sum_quality, CAST(sum(25 + l_linenumber) FILTER (supports) AS BIGINT) AS sum_score,
    CAST(sum(s + 3 * greatest(s + span, s + l_suppkey % 5 + 30)) FILTER (supports) AS BIGINT) AS sum_ends
  FROM m GROUP BY 1, 2"""


def support_types(spark, sf_dir):
    """Reads that support substitutions, insertions and deletions, by allele."""
    sites, rows, _ = E.marked_reads(variants(spark, sf_dir), reads(spark, sf_dir), _config("mark-support", "LQF"))
    sites = sites.select("variant_id", "alt_idx", "alt", "mut_type")
    n = rows.groupBy("variant_id", "alt_idx").agg(F.count_if("mark_supports_var").alias("n_support"), F.count("*").alias("n_reads"))
    return sites.join(n, ["variant_id", "alt_idx"], "left").na.fill(0, ["n_support", "n_reads"])


_SUPPORT_TYPES_SQL = f"""WITH {_RECORDS}, {_READS}, n AS (SELECT v, alt_idx, count(*) FILTER (supports) AS ns, count(*) AS nr FROM marked WHERE (flag & 3852) = 0 GROUP BY 1, 2)
  SELECT a.v AS variant_id, CAST(a.alt_idx AS INT) AS alt_idx, a.alt, CASE WHEN length(ref) = length(alt) THEN 'SUB' WHEN length(alt) < length(ref) THEN 'DEL' ELSE 'INS' END AS mut_type,
    CAST(coalesce(ns, 0) AS BIGINT) AS n_support, CAST(coalesce(nr, 0) AS BIGINT) AS n_reads FROM allele a LEFT JOIN n ON n.v = a.v AND n.alt_idx = a.alt_idx"""


_RUN = ("mark-support", "mark-low-qual", "LQF", "ALF")


def _records(spark, sf_dir):
    records = variants(spark, sf_dir)
    return E.records(records, E.flag(records, reads(spark, sf_dir), _config(*_RUN)))


def run_records(spark, sf_dir):
    """Failing flags and INFO values of each record."""
    return _records(spark, sf_dir).select("variant_id", F.array_join("failed", ";").alias("failed"), F.col("infos")["LQF"].alias("lqf"), F.col("infos")["ALF"].alias("alf"))


_T3 = r"regexp_replace(regexp_replace(printf('%.3f', {x}), '0+$', ''), '\.$', '.0')"
_RESULTS = f"""{_RECORDS}, {_READS}, g AS (SELECT v, alt_idx, count(*) FILTER (supports) AS n, count(*) FILTER (supports AND low) AS w,
      count(*) FILTER (supports AND NOT low) AS na, median(density) FILTER (supports AND NOT low) AS med FROM marked GROUP BY 1, 2),
  s AS (SELECT a.v, a.alt_idx, a.alt, coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(na, 0) AS na, med FROM allele a LEFT JOIN g ON g.v = a.v AND g.alt_idx = a.alt_idx),
  b AS (SELECT *, (CASE WHEN n > 0 AND w / CAST(n AS DOUBLE) > 0.99 THEN 2 ELSE 0 END) + (CASE WHEN n - w < 2 THEN 4 ELSE 0 END) AS bits FROM s),
  i AS (SELECT v, alt_idx, n > 0 AND bits > 0 AS l_bad, na > 0 AND med <= 0.93 AS a_bad,
      concat(alt, '|', CASE WHEN n = 0 THEN 'NA' WHEN bits = 0 THEN 'PASS' ELSE 'FAIL' END, '|0x', CASE WHEN n = 0 THEN 1 WHEN bits = 0 THEN 7 ELSE bits END, '|', n, '|',
        CASE WHEN n = 0 THEN '0' ELSE {_T3.format(x="w / CAST(n AS DOUBLE)")} END) AS lqf,
      concat(alt, '|', CASE WHEN na = 0 THEN 'NA' WHEN med <= 0.93 THEN 'FAIL' ELSE 'PASS' END, '|0x', CASE WHEN na = 0 THEN 1 ELSE 4 END, '|', na, '|',
        CASE WHEN na = 0 THEN 'NA' ELSE {_T3.format(x="med")} END) AS alf FROM b),
  info AS (SELECT v, concat_ws(';', CASE WHEN bool_or(a_bad) THEN 'ALF' END, CASE WHEN bool_or(l_bad) THEN 'LQF' END) AS failed,
      string_agg(lqf, ',' ORDER BY alt_idx) AS lqf, string_agg(alf, ',' ORDER BY alt_idx) AS alf FROM i GROUP BY 1)"""
_RUN_RECORDS_SQL = f"WITH {_RESULTS} SELECT l.v AS variant_id, failed, lqf, alf FROM live l LEFT JOIN info USING (v)"


def vcf_sink(spark, sf_dir):
    """The lines of a run's VCF, written to a file and read from it."""
    out = scratch.path(spark, "flagged")
    vcf.write_vcf(_records(spark, sf_dir), vcf.out_header(HEAD, _config(*_RUN), ["S1", "S0"]), out)
    return vcf.read_vcf(spark, out).select("pos0", "id", "filter", "info", "record_line")


_VCF_SINK_SQL = f"""WITH {_RESULTS}, o AS (SELECT l.*, string_split(line, chr(9)) AS f, coalesce(failed, '') AS failed, lqf, alf FROM live l LEFT JOIN info USING (v)),
  p AS (SELECT pos0, f, f[3] AS id, CASE WHEN failed = '' THEN f[7] WHEN f[7] = 'q10' THEN 'q10;' || failed ELSE failed END AS flt,
    concat_ws(';', f[8], 'ALF=' || alf, 'LQF=' || lqf) AS inf FROM o)
  SELECT CAST(pos0 AS BIGINT) AS pos0, id, flt AS filter, inf AS info, concat_ws(chr(9), f[1], f[2], f[3], f[4], f[5], f[6], flt, inf, f[9], f[10], f[11]) AS record_line FROM p"""


def vcf_header(spark, sf_dir):
    """Names of the header lines that a run adds, and its parameters, read back from the header."""
    head = vcf.out_header(HEAD, _config(*_RUN), ["S1", "S0"])
    kinds = [(x.partition("=")[0], x.partition("<ID=")[2].partition(",")[0]) for x in head[2:-1]]
    params = vcf.decode_params(vcf.params_in(head))["params"]
    lines = [(k.strip("#"), n, "") for k, n in kinds] + [(f"params.{p}", k, str(v)) for p, group in params.items() for k, v in group.items()]
    return spark.createDataFrame(lines, "kind string, name string, value string")


_VCF_HEADER_SQL = """SELECT * FROM (VALUES ('FILTER', 'ALF', ''), ('FILTER', 'ADF', ''), ('FILTER', 'DVF', ''), ('FILTER', 'LQF', ''),
  ('INFO', 'ADF', ''), ('INFO', 'ALF', ''), ('INFO', 'DVF', ''), ('INFO', 'LQF', ''), ('lociflow_version', '', ''), ('lociflow_params_info', '', ''), ('lociflow_params', '', ''), ('lociflow_samples', '', ''),
  ('params.mark-low-qual', 'min_avg_clip_quality', '35'), ('params.mark-low-qual', 'min_mapping_quality', '11'), ('params.mark-low-qual', 'min_base_quality', '25'),
  ('params.LQF', 'read_loss_threshold', '0.99'), ('params.LQF', 'min_pass_reads', '2'), ('params.LQF', 'nsamples_threshold', '0'), ('params.ALF', 'avg_AS_threshold', '0.93')) t(kind, name, value)"""


# --- alignments ---------------------------------------------------------------------------------


def sam_scan(spark, sf_dir):
    """The reads written as SAM text and read from it."""
    rows = reads(spark, sf_dir)
    text = F.concat_ws(
        "\t", "qname", "flag", "chrom", F.col("ref_start") + 1, "mapq", "cigar", F.lit("="), F.col("next_ref_start") + 1, F.lit(0), "seq",
        F.array_join(F.transform("quals", lambda q: F.char(q + 33)), ""), F.concat(F.lit("MC:Z:"), "mc"), F.concat(F.lit("AS:i:"), "as_score"),
    )
    out = scratch.path(spark, "reads")
    rows.select(text.alias("value")).union(spark.createDataFrame([("@RG\tID:x\tSM:S",)], "value string")).write.text(out)
    got = A.read_sam(spark, out)
    low = F.array_min("quals")
    return got.select("sample", "qname", "flag", "chrom", "ref_start", "ref_end", "mapq", "cigar", "next_ref_start", "seq", low.alias("least_quality"), F.size("quals").alias("n_quals"), "mc", "as_score", "as_type")


_SAM_SQL = f"""WITH {_READS.split("pile AS")[0].rstrip().rstrip(",")}
  SELECT 'S' AS sample, concat('r', l_orderkey, '_', l_linenumber, '_', l_suppkey, '_', l_extendedprice) AS qname, CAST(flag AS INT) AS flag, 'c1' AS chrom, CAST(l_partkey * 1000 + 500 - k AS BIGINT) AS ref_start,
    CAST(l_partkey * 1000 + 500 - k + span AS BIGINT) AS ref_end, mapq, {_CIGAR} AS cigar, CAST(l_partkey * 1000 + 500 - k + l_suppkey % 5 AS BIGINT) AS next_ref_start, seq,
    CAST(list_min(quals) AS INT) AS least_quality, CAST(len(quals) AS INT) AS n_quals, '30M' AS mc, CAST(25 + l_linenumber AS INT) AS as_score, 'i' AS as_type FROM rs"""


def sample_mapping(spark, sf_dir):
    """VCF samples and their files, by tag, by a mapping to tags, by a mapping to file names and by a list."""
    nations = [(r[0], r[1]) for r in table(spark, sf_dir, "nation").select("n_name", "n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    names = [n for n, _ in nations]
    tags = {f"/d/f{k}.bam": n for n, k in nations if k % 2 == 0}
    turned = dict(zip([n for n, k in nations if k % 2], list(tags.values()), strict=False))
    few = {f: n for f, n in tags.items() if n in turned.values()}
    by_file = {s: next(f for f, n in few.items() if n == t).rpartition("/")[2] for s, t in turned.items()}
    found = {"tags": A.match_samples(names, tags), "mapped tags": A.match_samples(names, few, turned), "mapped files": A.match_samples(names, few, by_file), "list": A.match_samples(names, tags, [names[3], "absent"])}
    return spark.createDataFrame([(how, s, f) for how, m in found.items() for s, f in m.items()], "how string, sample string, file string")


_MAPPING_SQL = """WITH t AS (SELECT n_name, n_nationkey AS k FROM nation), e AS (SELECT n_name, k, concat('/d/f', k, '.bam') AS file FROM t WHERE k % 2 = 0),
  turned AS (SELECT o.n_name AS sample, e.file FROM t o JOIN e ON o.k = e.k + 1)
  SELECT 'tags' AS how, n_name AS sample, file FROM e UNION ALL SELECT 'mapped tags', sample, file FROM turned UNION ALL SELECT 'mapped files', sample, file FROM turned
  UNION ALL SELECT 'list', (SELECT n_name FROM t WHERE k = 3), (SELECT file FROM e ORDER BY k DESC LIMIT 1)"""


# --- configurations -----------------------------------------------------------------------------


def config_steps(spark, sf_dir):
    """Enabled processes of the default graph in order, with the marks they require and exclude."""
    steps = K.compile_exec(K.merge([{"params": K.json_or_file(json.dumps(K.DEFAULT_PARAMS))}]))
    return spark.createDataFrame([(i, n, ",".join(r), ",".join(e)) for i, (n, r, e) in enumerate(steps)], "place int, process string, required string, excluded string")


_STEPS_SQL = """SELECT CAST(place AS INT) AS place, process, required, excluded FROM (VALUES (0, 'mark-support', '', ''), (1, 'mark-overlap', 'SUPPORTS-VAR', ''), (2, 'mark-low-qual', 'SUPPORTS-VAR', ''),
  (3, 'mark-duplicates', 'SUPPORTS-VAR', 'LOW-QUAL'), (4, 'LQF', 'SUPPORTS-VAR', 'IS-OVERLAPPING-READ2'), (5, 'DVF', 'SUPPORTS-VAR', 'IS-OVERLAPPING-READ2,LOW-QUAL'),
  (6, 'ALF', 'SUPPORTS-VAR', 'LOW-QUAL,IS-OVERLAPPING-READ2,IS-STUTTER-DUP'), (7, 'ADF', 'SUPPORTS-VAR', 'LOW-QUAL,IS-OVERLAPPING-READ2,IS-STUTTER-DUP')) t(place, process, required, excluded)"""

#: Changes to the default configuration, and whether it can still be run.
CHANGES = [
    ("params.mark-duplicates.duplication_window_size", "-1", True),
    ("params.mark-duplicates.duplication_window_size", "-2", False),
    ("params.mark-low-qual.min_mapping_quality", "255", True),
    ("params.mark-low-qual.min_mapping_quality", "256", False),
    ("params.LQF.read_loss_threshold", "1", True),
    ("params.LQF.read_loss_threshold", "1.01", False),
    ("params.ADF.min_sd_one_strand", "text", False),
    ("params.ADF.absent", "1", False),
    ("params.ADF", "1", False),
    ("exec.ADF.exclude-marks", "[]", False),
    ("exec.mark-overlap.enable", "false", False),
    ("exec.ALF.enable", "false", True),
    ("exec.mark-support.enable", "false", False),
    ("exec.opts.mandate-excludes", "1", False),
]


def config_changes(spark, sf_dir):
    """Whether the default configuration can be run after each of ``CHANGES``."""

    def runs(path: str, value: str) -> bool:
        try:
            K.compile_exec(K.override(K.default(), path, value))
        except K.ConfigError:
            return False
        return True

    return spark.createDataFrame([(p, v, runs(p, v)) for p, v, _ in CHANGES], "path string, value string, runs boolean")


_CHANGES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{v}', {ok})" for p, v, ok in CHANGES) + ") t(path, value, runs)"

PAIRS = {
    run_marks: _RUN_MARKS_SQL,
    support_types: _SUPPORT_TYPES_SQL,
    run_records: _RUN_RECORDS_SQL,
    vcf_scan: _VCF_SCAN_SQL,
    vcf_sink: _VCF_SINK_SQL,
    vcf_header: _VCF_HEADER_SQL,
    sam_scan: _SAM_SQL,
    sample_mapping: _MAPPING_SQL,
    config_steps: _STEPS_SQL,
    config_changes: _CHANGES_SQL,
}


def queries() -> dict:
    return {f.__name__: f for f in PAIRS}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: q for f, q in PAIRS.items()}
