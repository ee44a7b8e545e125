"""Registers the queries of this subpackage."""

from seriesforge.llm import queries_chats, queries_documents, queries_pages, queries_tokens, queries_vectors  # noqa: F401
from seriesforge.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
