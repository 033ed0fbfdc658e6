"""Loads all queries of the training-data operators into ``common.QUERIES``."""

from sheetloom.llm import balanced, bpe, fingerprints, jaccard, langid, merkle, packing, pii, suffixes, tokens, topk, toxicity, trie  # noqa: F401
from sheetloom.llm.common import ORACLES, QUERIES  # noqa: F401
