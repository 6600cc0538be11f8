"""Importing this module registers every query of the corpus operators."""

from typeloom.llm import (
    centroids,
    chat,
    decontaminate,
    linedup,
    mixing,
    neardup,
    phrases,
    pii,
    quality,
    secrets,
    suffixes,
    toxicity,
    trie,
)
from typeloom.llm.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "centroids",
    "chat",
    "decontaminate",
    "linedup",
    "mixing",
    "neardup",
    "phrases",
    "pii",
    "quality",
    "secrets",
    "suffixes",
    "toxicity",
    "trie",
]
