"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import decontamination, fill_in_middle, language_id, merkle, minhash, overlap_join, packing, ppm, quality_rules, sharding, suffix_dedup, token_counts, warc

QUERIES = {f.__name__: f for f in (suffix_dedup.op1_suffix_dedup, ppm.op2_ppm, token_counts.op3_token_counts, sharding.op4_sharding, warc.op5_warc, language_id.op6_language_id, quality_rules.op7_quality_rules, decontamination.op8_decontamination, packing.op9_packing, minhash.op10_minhash, overlap_join.op11_overlap_join, fill_in_middle.op12_fill_in_middle, merkle.op13_merkle)}
ORACLES: dict[str, str] = {"op5_warc": warc.SQL, "op7_quality_rules": quality_rules.SQL, "op10_minhash": minhash.SQL, "op11_overlap_join": overlap_join.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_merkle": merkle.SQL}
