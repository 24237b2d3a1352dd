"""All queries of the subpackage; importing this module registers them."""

from vigil.llm import q_exact_dedup, q_lexicon_bpe, q_lm, q_merkle, q_mixing, q_ngram_join, q_packing, q_pseudonyms, q_quality, q_token_files, q_topk, q_toxicity, q_whitening  # noqa: F401
from vigil.llm.registry import ORACLE, QUERIES  # noqa: F401
