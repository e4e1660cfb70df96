"""The queries of this subpackage and, where SQL can express one, its statement."""

from __future__ import annotations

from firnline.llm.bpe import op8_bpe_encoding_and_decoding
from firnline.llm.ctw import op11_lm_scoring
from firnline.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from firnline.llm.fingerprints import op10_document_fingerprints
from firnline.llm.line_dedup import op3_line_dedup
from firnline.llm.merkle import OP12_SQL, op12_merkle_dataset_manifest
from firnline.llm.mixing import op9_mixing_sources_to_target_weights
from firnline.llm.near_dedup import op6_minhash_near_dedup
from firnline.llm.prefix_trie import OP13_SQL, op13_conversation_prefix_trie
from firnline.llm.quality import op1_quality_classifier
from firnline.llm.toxicity import op7_toxicity
from firnline.llm.url_filter import op4_url_filters
from firnline.llm.warc import op5_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_exact_dedup,
        op3_line_dedup,
        op4_url_filters,
        op5_warc,
        op6_minhash_near_dedup,
        op7_toxicity,
        op8_bpe_encoding_and_decoding,
        op9_mixing_sources_to_target_weights,
        op10_document_fingerprints,
        op11_lm_scoring,
        op12_merkle_dataset_manifest,
        op13_conversation_prefix_trie,
    )
}
ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op12_merkle_dataset_manifest": OP12_SQL,
    "op13_conversation_prefix_trie": OP13_SQL,
}
