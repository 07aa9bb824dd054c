"""The text operators as queries (spark, sf_dir) over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
from tagmill.llm import html_main, lexical, lm_trie, merkle, mixing, ngram_join, pieces, pii, quality_ordinal, quality_rules, sequences, suffix_dedup, topk
from tagmill.llm.common import table

QUERIES = {
    "op1_ordinal": lambda spark, d: quality_ordinal.op1_ordinal(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_mixing": lambda spark, d: mixing.op2_mixing(table(spark, d, "documents")),
    "op3_pii": lambda spark, d: pii.op3_pii(table(spark, d, "documents")),
    "op4_pieces": lambda spark, d: pieces.op4_pieces(table(spark, d, "documents"), pieces.model_bytes()),
    "op5_html_main": lambda spark, d: html_main.op5_html_main(table(spark, d, "pages")),
    "op6_suffix_dedup": lambda spark, d: suffix_dedup.op6_suffix_dedup(table(spark, d, "documents")),
    "op7_quality_rules": lambda spark, d: quality_rules.op7_quality_rules(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_ngram_join": lambda spark, d: ngram_join.op8_ngram_join(table(spark, d, "documents")),
    "op10_lm_trie": lambda spark, d: lm_trie.op10_lm_trie(table(spark, d, "documents")),
    "op9_topk": lambda spark, d: topk.op9_topk(table(spark, d, "embeddings")),
    "op11_merkle": lambda spark, d: merkle.op11_merkle(table(spark, d, "documents")),
    "op12_sequences": lambda spark, d: sequences.op12_sequences(table(spark, d, "documents"), sequences.default_tokenizer()),
    "op13_lexical": lambda spark, d: lexical.op13_lexical(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op5_html_main": html_main.ORACLE, "op9_topk": topk.ORACLE, "op13_lexical": lexical.ORACLE}
