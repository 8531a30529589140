"""The corpus operators' queries and SQL by name."""

from . import huffman, language, leaks, licenses, packing, pages, privacy, quality, sharding, simhash

_MODULES = (packing, simhash, language, licenses, leaks, huffman, quality, pages, privacy, sharding)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
