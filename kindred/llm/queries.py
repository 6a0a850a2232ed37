"""Registered queries of the training-text operators, with their SQL where SQL can say it."""

from kindred.llm import (decontaminate, lexical, lines, mix, paragraphs, phrases, quality, shard, simhash, suffixes,
                         tokens, topk, warc)

QUERIES = {
    "op1_token_counts": (tokens.op1_token_counts, None),
    "op2_suffix_dedup": (suffixes.op2_suffix_dedup, None),
    "op3_quality_classifier": (quality.op3_quality_classifier, None),
    "op4_line_rules": (lines.op4_line_rules, lines.SQL),
    "op5_mix_sources": (mix.op5_mix_sources, mix.SQL),
    "op6_warc": (warc.op6_warc, warc.SQL),
    "op7_paragraph_dedup": (paragraphs.op7_paragraph_dedup, None),
    "op8_simhash_dedup": (simhash.op8_simhash_dedup, None),
    "op9_shard_rows": (shard.op9_shard_rows, shard.SQL),
    "op10_decontaminate": (decontaminate.op10_decontaminate, None),
    "op11_lexical_search": (lexical.op11_lexical_search, lexical.SQL),
    "op12_exact_topk": (topk.op12_exact_topk, topk.SQL),
    "op13_phrase_mining": (phrases.op13_phrase_mining, phrases.SQL),
}
