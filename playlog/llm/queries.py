"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from playlog.llm import ann, bpe, chat, ctw, jaccard, licenses, packing, pii, quality, suffix

_MODULES = (bpe, packing, chat, ann, quality, pii, jaccard, suffix, ctw, licenses)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
