"""The corpus queries, for the registry in ``__spark_entry__``."""

from __future__ import annotations

from . import checks, langid, licenses, media, mixing, neardup, pages, pieces, quality, sharding, tokens


def queries() -> dict:
    found = [
        tokens.op1_token_ids,
        licenses.op2_license_scan,
        media.op3_peak_fingerprints,
        langid.op4_bloom_langid,
        mixing.op5_entropy_balance,
        neardup.op6_minhash_hamming,
        pieces.op7_sampled_pieces,
        pages.op8_host_suffixes,
        quality.op9_ngram_ratio,
        sharding.op10_external_shuffle,
    ]
    return {f.__name__: f for f in found} | checks.queries()


def oracle_sql() -> dict[str, str]:
    return checks.oracle_sql()
