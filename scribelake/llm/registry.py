"""The queries of this subpackage and their SQL, where SQL can express them."""

from importlib import import_module

_MODULES = ("pii", "quality", "toxicity", "simhash", "decontamination", "token_files", "packing", "fingerprints", "langid", "url_rules", "window_packing", "alignment", "ranked_search")
_loaded = [import_module(f"{__package__}.{name}") for name in _MODULES]
QUERIES = {k: f for m in _loaded for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _loaded for k, s in m.ORACLE_SQL.items()}
