"""The registered queries of the engine and their SQL oracles."""

from veristrata.plans import claims, decisions, duplicates, evaluation, leakage, messages, metrics, more, retrieval, samples, streams, text, verification  # noqa: F401
from veristrata.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bm25_global_topk"
