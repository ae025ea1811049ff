"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .chat import OP6_SQL, op6_budgeted_chat
from .decontaminate import op1_latent_decontamination
from .jaccard import OP9_SQL, op9_ngram_jaccard_join
from .mixing import op2_soft_mixing
from .packing import op10_packed_token_ids
from .quality import op7_subword_quality
from .secrets import op5_char_cnn_secrets
from .substring import OP3_SQL, op3_relative_lz_dedup
from .topk import OP8_SQL, op8_block_pruned_topk
from .warc import OP4_SQL, op4_warc_normaliser

QUERIES = {
    "op1_latent_decontamination": op1_latent_decontamination,
    "op2_soft_mixing": op2_soft_mixing,
    "op3_relative_lz_dedup": op3_relative_lz_dedup,
    "op4_warc_normaliser": op4_warc_normaliser,
    "op5_char_cnn_secrets": op5_char_cnn_secrets,
    "op6_budgeted_chat": op6_budgeted_chat,
    "op7_subword_quality": op7_subword_quality,
    "op8_block_pruned_topk": op8_block_pruned_topk,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_packed_token_ids": op10_packed_token_ids,
}
ORACLES: dict[str, str] = {
    "op3_relative_lz_dedup": OP3_SQL,
    "op4_warc_normaliser": OP4_SQL,
    "op6_budgeted_chat": OP6_SQL,
    "op8_block_pruned_topk": OP8_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
}
