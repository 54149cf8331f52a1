"""Queries of the training-data operators by name."""

from __future__ import annotations

from gleaner.llm import divergence, fmindex, langid, lzprint, minhash, mixing, mtree, packing, repair, sharding, simhash, suffix, toxicity


def queries() -> dict:
    return {
        "op1_langid": langid.query,
        "op2_mixing": mixing.query,
        "op3_mtree_topk": mtree.query,
        "op4_hilbert_sharding": sharding.query,
        "op5_simhash": simhash.query,
        "op6_suffix_dedup": suffix.query,
        "op7_lz_fingerprints": lzprint.query,
        "op8_fm_dedup": fmindex.query,
        "op9_toxicity": toxicity.query,
        "op10_packing": packing.query,
        "op11_divergence": divergence.query,
        "op12_minhash": minhash.query,
        "op13_repair": repair.query,
    }


def oracle_sql() -> dict:
    return {
        "op2_mixing": mixing.SQL, "op3_mtree_topk": mtree.SQL, "op8_fm_dedup": fmindex.SQL, "op11_divergence": divergence.SQL,
        "op12_minhash": minhash.SQL, "op13_repair": repair.SQL,
    }
