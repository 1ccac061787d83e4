"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from memloom.plans import agents, analyses, canvases, derivations, entities, extractions, graphs, histories, loaders, metrics, references, retrieval, selections, storage, texts

_MODULES = (references, texts, retrieval, graphs, selections, histories, extractions, metrics, storage, derivations, canvases, entities, agents, analyses, loaders)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "p2_report"
