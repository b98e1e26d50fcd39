"""The queries of the operators and their SQL."""

from __future__ import annotations

from tidemark.llm import bpe, chat, classifier, licenses, mixing, neighbours, ngrams, pages, passages, periodic, secrets, spotsigs, whitening

MODULES = (ngrams, mixing, secrets, pages, spotsigs, classifier, chat, bpe, neighbours, passages, whitening, licenses, periodic)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
