"""The registered queries of the engine."""

from __future__ import annotations

from cellweave.plans import answers, candidates, corpora, evaluation, linking, merges, parts, reasoning, samples
from cellweave.plans.registry import REGISTRY

FLAGSHIP = candidates.FLAGSHIP
_MODULES = (answers, linking, parts, candidates, corpora, evaluation, merges, reasoning, samples)


def queries() -> dict:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
