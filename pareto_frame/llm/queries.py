"""Imports every query module, which registers its queries."""

from pareto_frame.llm import (  # noqa: F401
    query_bpe,
    query_chat,
    query_hyperminhash,
    query_language,
    query_lines,
    query_merkle,
    query_packing,
    query_quality,
    query_secrets,
    query_token_files,
    query_topk,
    query_vectors,
    query_whitening,
)
from pareto_frame.llm.registry import ORACLES, QUERIES  # noqa: F401
