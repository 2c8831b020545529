"""Variant flagging on Spark: pileups, read marks and per-allele tests as DataFrame plans."""
