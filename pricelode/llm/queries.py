"""Registered queries of this package: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from pricelode.llm import (
    bayes_jaccard, bwt_repeats, chat_parts, exact_shuffle, phrase_parse, piece_codec, robust_outliers, secret_dfa, site_lines, source_mix,
    spaced_seeds, target_resample, wavelet_store,
)
from pricelode.llm.common import table


def _documents(query):
    return lambda spark, root: query(table(spark, root, "documents"))


QUERIES = {
    "op1_piece_codec": _documents(piece_codec.codec_query),
    "op2_robust_outliers": _documents(robust_outliers.quality_query),
    "op3_bwt_repeats": _documents(bwt_repeats.repeats_query),
    "op4_bayes_jaccard": _documents(bayes_jaccard.join_query),
    "op5_wavelet_store": _documents(wavelet_store.store_query),
    "op6_exact_shuffle": _documents(exact_shuffle.shards_query),
    "op7_site_lines": _documents(site_lines.lines_query),
    "op8_chat_parts": lambda spark, root: chat_parts.chat_digest(table(spark, root, "conversations")),
    "op9_secret_automaton": _documents(secret_dfa.secret_digest),
    "op10_spaced_seeds": lambda spark, root: spaced_seeds.overlap_query(table(spark, root, "documents"), table(spark, root, "benchmark")),
    "op11_target_resample": lambda spark, root: target_resample.resample_query(table(spark, root, "documents"), table(spark, root, "benchmark")),
    "op12_source_mix": _documents(source_mix.mix_query),
    "op13_phrase_parse": _documents(phrase_parse.phrase_query),
}
ORACLES = {
    "op7_site_lines": site_lines.LINES_SQL, "op8_chat_parts": chat_parts.CHAT_SQL,
    "op11_target_resample": target_resample.RESAMPLE_SQL, "op12_source_mix": source_mix.MIX_SQL, "op13_phrase_parse": phrase_parse.PHRASE_SQL,
}
