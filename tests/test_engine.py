"""The plan against hand-made reads, and a row-at-a-time model written from the rules."""

import random
import statistics

import pytest

from lociflow import schema
from lociflow.cli import explain_text
from lociflow.operators.marks import duplicate_marks
from lociflow.plans import config as K
from lociflow.plans import engine


def read(order, start=100, flag=0x43, cigar="100M", seq="CTGDAAAACC" * 10, quals=None, qname=None, mate=None, mc="100M", score=None, mapq=40, sample="S"):
    from_cigar = sum(int(n) for n, op in __import__("re").findall(r"(\d+)([MDN=X])", cigar))
    return (sample, order, qname or f"r{order}", flag, "1", start, start + from_cigar, mapq, cigar, start if mate is None else mate, seq, quals or [40] * len(seq), mc, score, "i" if score is not None else None)


def variant(pos0, ref="A", alts=("A",), gts=None, vid=0):
    return (vid, "1", pos0, pos0 + len(ref), len(ref), ".", ref, list(alts), ".", ".", ".", gts or {"S": [0, 1]}, f"1\t{pos0 + 1}\t.\t{ref}\t{','.join(alts)}\t.\t.\t.\tGT\t0/1")


def flags(spark, variants, reads, **kw):
    v = spark.createDataFrame(variants, schema.VARIANTS)
    r = spark.createDataFrame(reads, schema.READS)
    return {(x.variant_id, x.alt_idx, x.flag): x for x in engine.flag(v, r, **kw).collect()}


def seq_with(base_at, base="A"):
    s = ["C"] * 100
    s[base_at] = base
    return "".join(s)


@pytest.mark.parametrize(
    "reads, want",
    [
        ([], ("NA", 0x1, "BOTH")),
        ([(100, 0x43), (100, 0x53)], ("NA", 0x2, "BOTH")),
        ([(100, 0x43), (100, 0x43)], ("FAIL", 0x8, "F")),
        ([(100, 0x43), (90, 0x43)], ("PASS", 0x4F, "F")),
        ([(100, 0x53), (100, 0x53)], ("FAIL", 0x8, "R")),
        ([(100, 0x53), (90, 0x53)], ("PASS", 0x4F, "R")),
        ([(100, 0x43), (100, 0x43), (100, 0x53), (100, 0x53)], ("PASS", 0x47, "BOTH")),
    ],
)
def test_placement(spark, reads, want):
    rows = [read(i, start, flag, seq=seq_with(150 - start)) for i, (start, flag) in enumerate(reads)]
    got = flags(spark, [variant(150)], rows)[0, 0, "ADF"]
    assert (got.outcome, got.info_bits, got.extra) == want


def test_placement_at_edges(spark):
    rows = [read(i, s, f, seq=seq_with(198 - s)) for i, (s, f) in enumerate([(190, 0x43), (190, 0x43), (100, 0x53), (100, 0x53)])]
    config = K.override(K.default(), "params.mark-duplicates.duplication_window_size", "-1")
    got = flags(spark, [variant(198)], rows, config=config)[0, 0, "ADF"]
    assert (got.outcome, got.info_bits, got.extra) == ("FAIL", 0x74, "BOTH")


@pytest.mark.parametrize("scores, want", [([50, 50], ("FAIL", 4, "0.5")), ([99, 99], ("PASS", 4, "0.99")), ([None, None], ("NA", 2, "NA")), ([], ("NA", 1, "NA"))])
def test_alignment_score(spark, scores, want):
    rows = [read(i, seq=seq_with(50), score=s) for i, s in enumerate(scores)]
    got = flags(spark, [variant(150)], rows)[0, 0, "ALF"]
    assert (got.outcome, got.info_bits, got.extra) == want
    assert got.info == f"A|{want[0]}|0x{want[1]:x}|{len(scores)}|{want[2]}"


# Fixed value: the bases of the sample read, ten to a repeat.
TEN = "CTGDAAAACC"


@pytest.mark.parametrize(
    "pos, ref, alt, cigar, want",
    [
        (99, "G", "A", "10M", 1),
        (99, "G", "T", "10M", 0),
        (98, "CCC", "C", "4M2D6M", 1),
        (98, "CCC", "CC", "4M1D6M", 0),
        (98, "CCC", "CC", "10M", 0),
        (99, "G", "AA", "5M1I4M", 1),
        (99, "G", "AC", "5M1I4M", 0),
        (99, "G", "ATTTTTTTTTTTTTT", "5M2I3M", 0),
    ],
)
def test_support(spark, pos, ref, alt, cigar, want):
    got = flags(spark, [variant(pos, ref, (alt,))], [read(0, 95, seq=TEN, cigar=cigar, mc="10M")])
    assert got[0, 0, "LQF"].reads_seen == want


def test_records_that_leave(spark):
    vs = [variant(150, vid=0), variant(150, alts=(), vid=1), variant(150, gts={"S": [0, 0]}, vid=2), variant(150, alts=("<DEL>",), vid=3), variant(150, gts={"S": [0]}, vid=4), variant(150, gts={"S": [None, None]}, vid=5)]
    v = spark.createDataFrame(vs, schema.VARIANTS)
    r = spark.createDataFrame([read(0, seq=seq_with(50))], schema.READS)
    out = engine.records(v, engine.flag(v, r)).select("variant_id", "infos").collect()
    assert {x.variant_id: x.infos is not None for x in out} == {0: True, 3: False, 4: True, 5: True}


def test_duplicate_pools():
    a, b, c, d, e = (0, 1, 2, 3), (0, 1, 2, 4), (50, 51, 52, 53), (50, 51, 52, 54), (99, 99, 99, 99)
    quality = [1, 2, 3, 4, 5]
    assert duplicate_marks([a, b, c, d, e], quality, 6, False) == [True, False, False, False, False]
    assert duplicate_marks([a, b, c, d, e], quality, 6, True) == [True, False, True, False, False]
    assert duplicate_marks([a, b], quality, 6, False) == [False, False]


def model(reads, pos, alt, p=K.DEFAULT_PARAMS):
    """Results of the default graph for one substitution, one read at a time."""
    rows = []
    for r in reads:
        m = pos - r[5]
        if r[3] & 3 != 3 or r[3] & 3852 or not 0 <= m < 100 or r[10][m] != alt:
            continue
        low = r[7] < 11 or r[11][m] < 25
        rows.append({"r": r, "m": m, "low": low, "q": statistics.fmean(r[11]), "ov": False, "dup": False, "rev": bool(r[3] & 16), "ends": sorted((r[5], r[6], r[9], r[9] + 100))})
    first = {}
    for x in rows:
        y = first.setdefault(x["r"][2], x)
        if y is not x:
            (x if x["q"] <= y["q"] else y)["ov"] = True
    pool = sorted((x for x in rows if not x["low"]), key=lambda x: x["ends"][0])
    if pool:
        group, ends = [pool[0]], [pool[0]["ends"]]
        for x in pool[1:]:
            if all(abs(u - w) <= 6 for e in ends for u, w in zip(e, x["ends"])):
                group.append(x)
                ends.append(x["ends"])
                continue
            starter = x
            if len(group) > 1:
                for y in sorted(group, key=lambda y: y["q"])[:-1]:
                    y["dup"] = True
                    starter = y
            group, ends = [starter], [x["ends"]]
    lq = [x for x in rows if not x["ov"]]
    n, w = len(lq), sum(x["low"] or x["dup"] for x in lq)
    lqf = (1 if not n else ((2 if w / n > 0.99 else 0) | (4 if n - w < 2 else 0)) or 7)
    dv = [x for x in rows if not x["ov"] and not x["low"]]
    n2, w2 = len(dv), sum(x["dup"] for x in dv)
    dvf = (1 if not n2 else ((2 if w2 / n2 > 0.49 else 0) | (4 if n2 - w2 < 2 else 0)) or 7)
    rest = [x for x in dv if not x["dup"]]
    scores = [x["r"][13] / 100 for x in rest if x["r"][13] is not None]
    alf = (1 if not rest else 2) if not scores else ("FAIL" if statistics.median(scores) <= 0.93 else "PASS")
    return lqf, n, dvf, n2, alf, len(rest)


def test_random_pileups_match_the_model(spark):
    rng = random.Random(5)
    variants, reads, by_variant = [], [], {}
    for v in range(25):
        pos = 10_000 * (v + 1)
        variants.append(variant(pos, vid=v))
        mine = []
        for _ in range(rng.randrange(0, 40)):
            start = pos - rng.randrange(0, 110)
            bases = ["C"] * 100
            if 0 <= pos - start < 100 and rng.random() < 0.8:
                bases[pos - start] = "A"
            quals = [rng.randrange(20, 41) for _ in range(100)]
            mine.append(read(len(reads) + len(mine), start, rng.choice([0x43, 0x53, 0x443, 0x43]), seq="".join(bases), quals=quals, qname=f"q{v}_{rng.randrange(25)}", mate=start + rng.randrange(0, 30), score=rng.choice([None, 80, 93, 94, 99]), mapq=rng.choice([5, 30, 60])))
        reads += mine
        by_variant[v] = (mine, pos)
    got = flags(spark, variants, reads)
    for v, (mine, pos) in by_variant.items():
        lqf, n, dvf, n2, alf, n3 = model(mine, pos, "A")
        assert (got[v, 0, "LQF"].info_bits, got[v, 0, "LQF"].reads_seen) == (lqf, n), v
        assert (got[v, 0, "DVF"].info_bits, got[v, 0, "DVF"].reads_seen) == (dvf, n2), v
        a = got[v, 0, "ALF"]
        assert a.reads_seen == n3 and (a.outcome == alf if isinstance(alf, str) else a.info_bits == alf), v
        assert got[v, 0, "ADF"].reads_seen == n3


def test_config_rules():
    K.compile_exec(K.default())
    bad = K.default()
    bad["exec"]["mark-duplicates"]["require-marks"] = ["NOPE"]
    with pytest.raises(K.ConfigError):
        K.compile_exec(bad)
    with pytest.raises(K.ConfigError):
        K.compile_exec(K.override(K.default(), "params.ADF.edge_definition", "2"))
    with pytest.raises(K.ConfigError):
        K.override(K.default(), "params.ADF", "1")
    off = K.override(K.default(), "exec.mark-duplicates.enable", "false")
    with pytest.raises(K.ConfigError):
        K.compile_exec(off)
    K.compile_exec(K.override(off, "exec.opts.mandate-excludes", "false"))
    with pytest.raises(K.ConfigError):
        K.merge([{"params": {}}, {"params": {}}])


def test_added_processes(spark):
    from pyspark.sql import functions as F

    from lociflow.operators import flags as FL
    from lociflow.operators import marks as M

    registry = engine.builtin()
    registry.tagger("mark-far", "FAR", engine.condition(lambda p: F.col("mut_qpos") >= p["least"], "FAR"), {"least": (int, 0, None)})
    registry.flagger("FARF", FL.proportion((M.column("FAR"),)), K.RULES["DVF"])
    config = K.default()
    graph = config["exec"]
    config["exec"] = {"mark-support": graph["mark-support"], "mark-far": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": []}, "FARF": {"enable": True, "require-marks": ["SUPPORTS-VAR"], "exclude-marks": []}, "opts": graph["opts"]}
    config["params"] = {"mark-far": {"least": 50}, "FARF": dict(K.DEFAULT_PARAMS["DVF"])}
    rows = [read(i, 150 - at, seq=seq_with(at)) for i, at in enumerate([10, 20, 60])]
    got = flags(spark, [variant(150)], rows, config=config, registry=registry)
    assert (got[0, 0, "FARF"].reads_seen, got[0, 0, "FARF"].extra) == (3, "0.333")


def test_explain():
    assert explain_text("ADF=G|PASS|0x77|19|BOTH")[0] == "FLAG: ADF"
    for text in ("ADF", "ADF=a=b", "XXX=G|PASS|0x1|1|x", "ADF=G|PASS|0x77|19"):
        with pytest.raises(ValueError):
            explain_text(text)
