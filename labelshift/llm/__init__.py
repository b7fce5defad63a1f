"""Operators of a training-data pipeline."""

from . import (  # noqa: F401
    clustering,
    decontamination,
    exact_dedup,
    importance,
    language,
    near_dedup,
    packing,
    paragraph_dedup,
    ppm,
    prefix_trie,
    sharding,
    toxicity,
    warc,
)
from .book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
