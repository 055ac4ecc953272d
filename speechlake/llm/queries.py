"""Queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, embedding_dedup, lm, minhash, mixing, negatives, packing, quality, recompression, repair, sharding, token_output, url_filters

QUERIES = {
    "op1_systematic_mix": mixing.op1_systematic_mix,
    "op2_byte_planes": token_output.op2_byte_planes,
    "op3_event_fold": chat.op3_event_fold,
    "op4_best_fit": packing.op4_best_fit,
    "op5_url_rules": url_filters.op5_url_rules,
    "op6_sampled_splitters": sharding.op6_sampled_splitters,
    "op7_spherical_caps": embedding_dedup.op7_spherical_caps,
    "op8_bag_minhash": minhash.op8_bag_minhash,
    "op9_log_bilinear": lm.op9_log_bilinear,
    "op10_weak_supervision": quality.op10_weak_supervision,
    "op11_auction_repair": repair.op11_auction_repair,
    "op12_threshold": negatives.op12_threshold,
    "op13_recompression": recompression.op13_recompression,
}
SQL = {
    "op1_systematic_mix": mixing.OP1_SQL,
    "op3_event_fold": chat.OP3_SQL,
    "op5_url_rules": url_filters.OP5_SQL,
    "op10_weak_supervision": quality.OP10_SQL,
    "op11_auction_repair": repair.OP11_SQL,
    "op12_threshold": negatives.OP12_SQL,
    "op13_recompression": recompression.OP13_SQL,
}
