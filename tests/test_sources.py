"""VCF, SAM and BAM files of our own making, and a whole run from files to a VCF."""

import gzip
import json
import struct

import pytest

from lociflow import cli
from lociflow.sources import alignments as A
from lociflow.sources import vcf

HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tN\tT"]
BODY = ["1\t151\t.\tC\tA\t.\t.\tDP=3\tGT:X\t0/0:1\t0|1:2", "1\t160\trs\tC\t.\t.\tPASS\t.\tGT\t0/0\t0/1", "1\t170\t.\tC\tG,T\t9\tq10\t.\tGT\t./.\t0"]


def sam_line(i, start, base_at, flag=67, tags="MC:Z:100M\tAS:i:99"):
    seq = ["C"] * 100
    seq[base_at] = "A"
    return f"r{i}\t{flag}\t1\t{start + 1}\t40\t100M\t=\t{start + 1}\t0\t{''.join(seq)}\t{'I' * 100}\t{tags}"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in.vcf").write_text("\n".join(HEAD + BODY) + "\n")
    lines = ["@HD\tVN:1.6", "@SQ\tSN:1\tLN:1000", "@RG\tID:x\tSM:T", *[sam_line(i, s, 150 - s) for i, s in enumerate([100, 90, 80])]]
    (tmp_path / "t.sam").write_text("\n".join(lines) + "\n")
    return tmp_path


def to_bam(text):
    """BAM bytes of a SAM text with one reference and plain tags."""
    head = [x for x in text.splitlines() if x.startswith("@")]
    raw = "\n".join(head).encode() + b"\n"
    out = b"BAM\x01" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 1000)
    for line in text.splitlines():
        if line.startswith("@"):
            continue
        f = line.split("\t")
        name = f[0].encode() + b"\0"
        ops = [(int(n) << 4) | "MIDNSHP=X".index(o) for n, o in __import__("re").findall(r"(\d+)(.)", f[5])]
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in f[9]] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(f[9]), 2))
        tags = b"".join((t[:2] + "Z").encode() + t[5:].encode() + b"\0" if t[3] == "Z" else (t[:2] + "i").encode() + struct.pack("<i", int(t[5:])) for t in f[11:])
        body = struct.pack("<iiBBHHHiiii", 0, int(f[3]) - 1, len(name), int(f[4]), 0, len(ops), int(f[1]), len(f[9]), 0, int(f[7]) - 1, 0) + name + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(ord(c) - 33 for c in f[10]) + tags
        out += struct.pack("<i", len(body)) + body
    half = len(out) // 2
    return gzip.compress(out[:half]) + gzip.compress(out[half:])


def test_vcf_fields(spark, files):
    rows = vcf.read_vcf(spark, str(files / "in.vcf")).orderBy("variant_id").collect()
    assert [(r.pos0, r.stop0, r.alts) for r in rows] == [(150, 151, ["A"]), (159, 160, []), (169, 170, ["G", "T"])]
    assert rows[0].gts == {"N": [0, 0], "T": [0, 1]} and rows[2].gts == {"N": [None, None], "T": [0]}
    with pytest.raises(ValueError):
        vcf.samples(["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tN\tN"])


def test_bam_equals_sam(spark, files):
    (files / "t.bam").write_bytes(to_bam((files / "t.sam").read_text()))
    sam = A.read_alignment(spark, str(files / "t.sam")).drop("read_ord").orderBy("qname").collect()
    bam = A.read_alignment(spark, str(files / "t.bam")).drop("read_ord").orderBy("qname").collect()
    assert sam == bam and len(sam) == 3 and sam[0].sample == "T" and sam[0].ref_end == 200
    with pytest.raises(ValueError):
        A.read_alignment(spark, "x.cram")


def test_run_to_vcf(spark, files, capsys):
    out = files / "out"
    args = ["flag", str(files / "in.vcf"), str(files / "t.sam"), "-O", str(out), "-o", str(files / "used.json")]
    assert cli.main(args) == 0
    text = "".join(p.read_text() for p in sorted(out.glob("part-*"))).splitlines()
    head = [x for x in text if x.startswith("#")]
    body = [x.split("\t") for x in text if not x.startswith("#")]
    assert [x[1] for x in body] == ["151", "170"]
    assert body[0][6] == "." and body[0][7].startswith("DP=3;ADF=A|PASS|0x4f|3|F;ALF=A|PASS|0x4|3|0.99")
    assert "G|NA|0x1|0|BOTH,T|NA|0x1|0|BOTH" in body[1][7] and body[1][6] == "q10"
    assert vcf.decode_params(vcf.params_in(head), True) == json.loads((files / "used.json").read_text())


def test_sample_matching():
    tags = {"/d/a.bam": "SA", "/d/b.bam": "SB"}
    assert A.match_samples(["SA", "SB", "X"], tags) == {"SA": "/d/a.bam", "SB": "/d/b.bam"}
    assert A.match_samples(["V1", "V2"], tags, {"V1": "SA", "V2": "SB"}) == {"V1": "/d/a.bam", "V2": "/d/b.bam"}
    assert A.match_samples(["V1", "V2"], tags, {"V1": "b.bam", "V2": "a.bam"}) == {"V1": "/d/b.bam", "V2": "/d/a.bam"}
    assert A.match_samples(["V1"], tags, ["V1", "W"]) == {"V1": "/d/b.bam"}
    for names, m in ((["SA"], None), (["V1"], ["W"]), (["V1"], {"V1": "SA", "W": "SB"}), (["V1", "V2"], {"V1": "SA", "V2": "SA"})):
        with pytest.raises(ValueError):
            A.match_samples(names, tags, m)


def test_stream(spark, tmp_path):
    from lociflow import schema
    from lociflow.streaming.variants import flag_stream
    from tests.test_engine import read, seq_with, variant

    spark.createDataFrame([variant(150)], schema.VARIANTS).write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(schema.VARIANTS).parquet(str(tmp_path / "v"))
    reads = spark.createDataFrame([read(0, seq=seq_with(50))], schema.READS)
    flag_stream(stream, reads, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def bgzf(raw, size=700):
    """Blocks as a BAM file has them, and each block's place in the file by its first inflated byte."""
    import zlib

    out, places = b"", {}
    for at in [*range(0, len(raw), size), len(raw)]:
        part = raw[at : at + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        places[at] = len(out)
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out, places


def test_bam_in_ranges(spark, tmp_path):
    text = "\n".join(["@SQ\tSN:1\tLN:100000", "@RG\tID:x\tSM:T", *[sam_line(i, 100 + i, 50) for i in range(400)]]) + "\n"
    (tmp_path / "t.sam").write_text(text)
    raw = gzip.decompress(to_bam(text))
    out, places = bgzf(raw)
    (tmp_path / "t.bam").write_bytes(out)
    one = A.read_bam(spark, str(tmp_path / "t.bam"))
    assert one.rdd.getNumPartitions() == 1
    # an index with the place of every 50th record
    (n,) = struct.unpack_from("<i", raw, 4)
    at, found = 8 + n + 4 + 4 + 2 + 4, []
    while at < len(raw):
        found.append((places[at // 700 * 700] << 16) + at % 700)
        at += 4 + struct.unpack_from("<i", raw, at)[0]
    chunks = [(a, a + 1) for a in found[::50]]
    index = b"BAI\x01" + struct.pack("<ii", 1, 2) + struct.pack("<Ii", 4681, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks) + struct.pack("<IiQQQQ", 37450, 2, 1, 2, 3, 4) + struct.pack("<iQQ", 2, 0, found[75])
    (tmp_path / "t.bam.bai").write_bytes(index)
    many = A.read_bam(spark, str(tmp_path / "t.bam"), split_bytes=2000)
    assert many.rdd.getNumPartitions() > 4
    assert [r.read_ord for r in one.orderBy("read_ord").collect()] == found == [r.read_ord for r in many.orderBy("read_ord").collect()]
    sam = A.read_sam(spark, str(tmp_path / "t.sam")).drop("read_ord").orderBy("qname").collect()
    assert many.drop("read_ord").orderBy("qname").collect() == sam and len(sam) == 400
    (tmp_path / "cut.bam").write_bytes(out[: len(out) // 2])
    with pytest.raises(Exception, match="the file ends inside"):
        A.read_bam(spark, str(tmp_path / "cut.bam")).collect()


def test_override_of_lists_and_texts(caplog):
    from lociflow.plans import config as K

    with pytest.raises(K.ConfigError):
        K.override(K.default(), "exec.ADF.exclude-marks", "[]")
    changed = K.override(K.default(), "params.ALF.avg_AS_threshold", "not json")
    assert changed["params"]["ALF"]["avg_AS_threshold"] == "not json" and "not json" in caplog.text


def test_faulty_reads_and_results(spark):
    from pyspark.sql import functions as F

    from lociflow import schema
    from lociflow.operators import flags as FL
    from lociflow.plans import engine
    from tests.test_engine import read, seq_with, variant

    def flags(rows, **kw):
        return engine.flag(spark.createDataFrame([variant(150)], schema.VARIANTS), spark.createDataFrame(rows, schema.READS), **kw).collect()

    good = read(0, seq=seq_with(50))
    lacking = read(1, seq=seq_with(50), mc=None)
    with pytest.raises(Exception, match="essential field"):
        flags([good, lacking])
    assert {r.reads_seen for r in flags([good, lacking], strict=False)} == {1}
    assert len(flags([good, read(1, seq=seq_with(50), mc=None, flag=0x443)])) == 4  # such flags are refused before
    with pytest.raises(Exception, match="a read is there twice"):
        flags([good, good])
    with pytest.raises(Exception, match="AS tag of type"):
        flags([good[:-2] + (5, "f")])
    odd = spark.createDataFrame([good], schema.READS).withColumn("mc_type", F.lit("i"))
    with pytest.raises(Exception, match="MC tag of type"):
        engine.flag(spark.createDataFrame([variant(150)], schema.VARIANTS), odd).collect()
    test = FL.proportion(())
    for bits in (0, 8):
        with pytest.raises(Exception, match="reason bits"):
            spark.range(1).select(FL.checked_bits("X", test, F.lit(bits) + F.col("id").cast("int"))).collect()
