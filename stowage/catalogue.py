"""The registered queries over the reference operators, and their SQL."""

from __future__ import annotations

from .queries import checksums, decisions, entries, files, names, pathnames, progress, streams

MODULES = [names, pathnames, checksums, entries, streams, files, decisions, progress]
QUERIES = {k: f for m in MODULES for k, f in m.R.queries.items()}
ORACLES = {k: s for m in MODULES for k, s in m.R.oracles.items()}
