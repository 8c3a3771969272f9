"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

import corpus_pipeline
from shipcause.llm.ann_graph import op3_pruned_graph
from shipcause.llm.bpe import op10_byte_bpe
from shipcause.llm.html_text import op2_html_text
from shipcause.llm.line_dedup import OP13_SQL, op13_bloom_lines
from shipcause.llm.merkle import OP12_SQL, op12_merkle_butterfly
from shipcause.llm.minhash_join import OP8_SQL, op8_minhash_join
from shipcause.llm.mixing import op9_block_mix
from shipcause.llm.prefix_trie import OP11_SQL, op11_truncation_peeling
from shipcause.llm.quality_nbsvm import op4_nbsvm_quality
from shipcause.llm.rendezvous import op5_rendezvous_shards
from shipcause.llm.syncmers import op6_closed_syncmers
from shipcause.llm.toxicity import op1_clause_toxicity
from shipcause.llm.warc import OP7_SQL, op7_arc_to_warc

QUERIES = {
    "op1_clause_toxicity": op1_clause_toxicity,
    "op2_html_text": op2_html_text,
    "op3_pruned_graph": op3_pruned_graph,
    "op4_nbsvm_quality": op4_nbsvm_quality,
    "op5_rendezvous_shards": op5_rendezvous_shards,
    "op6_closed_syncmers": op6_closed_syncmers,
    "op7_arc_to_warc": op7_arc_to_warc,
    "op8_minhash_join": op8_minhash_join,
    "op9_block_mix": op9_block_mix,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_truncation_peeling": op11_truncation_peeling,
    "op12_merkle_butterfly": op12_merkle_butterfly,
    "op13_bloom_lines": op13_bloom_lines,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op7_arc_to_warc": OP7_SQL,
    "op8_minhash_join": OP8_SQL,
    "op11_truncation_peeling": OP11_SQL,
    "op12_merkle_butterfly": OP12_SQL,
    "op13_bloom_lines": OP13_SQL,
}
