"""Imports every operator module that registers a query."""

from footfall.llm import ann, bpe, chat, interaction, langid, linededup, linequality, manifest, mixing, pivots, simhash, surrogates, warczip  # noqa: F401
from footfall.llm.registry import ORACLES, QUERIES  # noqa: F401
