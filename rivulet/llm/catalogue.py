"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

import importlib

#: Modules in the order of their operators; each has ``NAME``, ``query`` and ``ORACLE_SQL``.
MODULES = ["jaccard", "substrings", "html", "toxicity", "langid", "topk", "decontaminate", "secrets", "bpe", "lines", "bytebpe", "periodic", "divergence"]

_loaded = [importlib.import_module(f"rivulet.llm.{m}") for m in MODULES]
QUERIES = {m.NAME: m.query for m in _loaded}
ORACLE_SQL = {m.NAME: m.ORACLE_SQL for m in _loaded if m.ORACLE_SQL}
