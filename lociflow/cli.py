"""Command line: flag a VCF from alignment files, explain an INFO value, read a run's parameters."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
import sys
import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import info
from .plans import config as K
from .plans import engine
from .sources import alignments, vcf

log = logging.getLogger("lociflow")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lociflow")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("flag", help="flag the variants of a VCF")
    run.add_argument("vcf")
    run.add_argument("alignments", nargs="+", help=".sam, .bam or .parquet files")
    run.add_argument("-c", "--config", action="append", default=[], help="TOML or JSON; may be given again")
    run.add_argument("--set", dest="sets", nargs=2, action="append", default=[], metavar=("PATH", "VALUE"))
    run.add_argument("-m", "--name-mapping", help="JSON, or a JSON file: sample names to alignments")
    run.add_argument("-o", "--output-config", help="write the merged configuration here as JSON")
    run.add_argument("-O", "--output", required=True, help="folder for the VCF part files")
    run.add_argument("--dup-mode", default="as_implemented", choices=["as_implemented", "as_documented"])
    run.add_argument("--lenient", action="store_true", help="reads that lack essential fields don't support an allele, instead of ending the run")
    run.add_argument("-q", "--quiet", action="count", default=0)
    run.add_argument("-p", "--progress", action="store_true", help="log how many tasks of the running stages are done, every few seconds")
    ex = sub.add_parser("explain-var", help="explain FLAG=alt|outcome|bits|reads|extra")
    ex.add_argument("info")
    gp = sub.add_parser("get-params", help="parameters that made a VCF")
    gp.add_argument("vcf")
    gp.add_argument("--exec", action="store_true", dest="with_exec")
    p.add_argument("-v", "--version", action="version", version=vcf.VERSION)
    return p


def configuration(files: list[str], sets: list[list[str]]) -> dict:
    if sets and not files:
        raise K.ConfigError("--set needs a --config to change")
    config = K.merge([K.load(f) for f in files]) if files else K.default()
    for path, value in sets:
        config = K.override(config, path, value)
    return config


PROGRESS_SECONDS = 5.0


@contextlib.contextmanager
def progress(spark: SparkSession, seconds: float):
    """Logs the running stages' tasks every so many seconds (0: never)."""
    over = threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def watch() -> None:
        while not over.wait(seconds):
            for k in tracker.getActiveStageIds():
                if (stage := tracker.getStageInfo(k)) is not None:
                    log.info("%s: %d of %d tasks done", stage.name, stage.numCompletedTasks, stage.numTasks)

    thread = threading.Thread(target=watch, daemon=True)
    if seconds:
        thread.start()
    try:
        yield
    finally:
        over.set()
        if seconds:
            thread.join()


def flag(spark: SparkSession, args: argparse.Namespace) -> None:
    config = configuration(args.config, args.sets)
    head = vcf.header(spark, args.vcf)
    names = vcf.samples(head)
    tags = {}
    for path in args.alignments:
        if path.lower().endswith(".sam"):
            tags[path] = alignments.sample_of([r[0] for r in spark.read.text(path).filter(F.col("value").startswith("@RG")).limit(1).collect()])
        elif path.lower().endswith(".bam"):
            tags[path] = alignments.sample_of(alignments.bam_header(spark, path))
        else:
            tags[path] = spark.read.parquet(path).select("sample").first()[0]
    mapping = K.json_or_file(args.name_mapping) if args.name_mapping else None
    chosen = alignments.match_samples(names, tags, mapping)
    if unused := set(names) - set(chosen):
        log.info("samples without an alignment: %s", sorted(unused))
    reads = None
    for i, (sample, path) in enumerate(chosen.items()):
        one = alignments.read_alignment(spark, path, sample, i)
        reads = one if reads is None else reads.unionByName(one, allowMissingColumns=True)
    variants = vcf.read_vcf(spark, args.vcf)
    results = engine.flag(variants, reads, config, dup_mode=args.dup_mode, strict=not args.lenient)
    with progress(spark, PROGRESS_SECONDS if args.progress else 0):
        vcf.write_vcf(engine.records(variants, results), vcf.out_header(head, config, list(chosen)), args.output)
    if args.output_config:
        with open(args.output_config, "w") as f:
            json.dump(config, f, indent="  ")


def explain_text(text: str) -> list[str]:
    """Lines that explain one INFO value; ValueError if it isn't one."""
    flag_name, eq, rest = text.partition("=")
    fields = rest.split("|")
    if not eq or "=" in rest or flag_name not in info.BITS or len(fields) < 5:
        raise ValueError(f"not a flag's INFO value: {text}")
    alt, outcome, code, reads, extra = fields[:5]
    names = [k for k, v in info.BITS[flag_name].items() if v & int(code, 16)]
    what = {"ADF": "strands tested", "ALF": "median score per base"}.get(flag_name, "share of marked reads")
    return [f"FLAG: {flag_name}", f"ALT: {alt}", f"OUTCOME: {outcome}", f"REASONS: {', '.join(names)}", f"READS: {reads}", f"{what}: {extra}"]


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if getattr(args, "quiet", 0) else logging.INFO)
    try:
        if args.command == "explain-var":
            print("\n".join(explain_text(args.info)))
            return 0
        spark = SparkSession.builder.appName("lociflow").getOrCreate()
        if args.command == "get-params":
            print(json.dumps(vcf.decode_params(vcf.params_in(vcf.header(spark, args.vcf)), args.with_exec)))
        else:
            flag(spark, args)
        return 0
    except ValueError as e:
        log.error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
