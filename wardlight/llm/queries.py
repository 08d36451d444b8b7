"""All registered queries of the subpackage and their SQL."""

from wardlight.llm import bpe, chat, covertree, decontamination, language, negatives, packing, pii, simhash, toxicity, trie, wavelet, wrapper  # noqa: F401
from wardlight.llm.tables import ORACLES, QUERIES  # noqa: F401
