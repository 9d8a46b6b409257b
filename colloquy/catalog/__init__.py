"""Registered queries and their checking SQL."""

from colloquy.catalog.registry import ORACLES, QUERIES  # noqa: F401
from colloquy.catalog import build, execution, extraction, gallery, identity, legacy, metrics, personal, provenance, rerank, retrieval, streams, views  # noqa: F401
