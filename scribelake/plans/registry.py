"""The queries of the reference's operators and their SQL."""

from importlib import import_module

_loaded = [import_module(f"{__package__}.{name}") for name in ("scalar", "relational", "live", "files")]
QUERIES = {k: f for m in _loaded for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _loaded for k, s in m.ORACLE_SQL.items()}
