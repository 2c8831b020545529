"""Schemas of the engine's relations."""

from __future__ import annotations

VARIANTS = (
    "variant_id long, chrom string, pos0 long, stop0 long, rlen int, id string, ref string, "
    "alts array<string>, qual string, filter string, info string, gts map<string, array<int>>, record_line string"
)
READS = (
    "sample string, read_ord long, qname string, flag int, chrom string, ref_start long, ref_end long, mapq int, "
    "cigar string, next_ref_start long, seq string, quals array<int>, mc string, as_score int, as_type string"
)
FLAG_RESULT = "variant_id long, alt_idx int, alt string, flag string, outcome string, info_bits int, reads_seen long, extra string"
