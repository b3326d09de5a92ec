"""The queries of the training-corpus operators, by name, and the SQL that some of them can be held against."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_language_id": "langid",
    "op2_nearest": "ann",
    "op3_pii": "pii",
    "op4_warc": "warc",
    "op5_near_duplicates": "neardup",
    "op6_quality": "quality",
    "op7_mixing": "mixing",
    "op8_lm_scoring": "lm",
    "op9_fingerprints": "fingerprint",
    "op10_packing": "packing",
    "op11_line_dedup": "linededup",
    "op12_prefix_trie": "prefixtrie",
    "op13_filter_audit": "audit",
}

_SQL = {
    "op4_warc": ("warc", "OP4_SQL"),
    "op5_near_duplicates": ("neardup", "OP5_SQL"),
    "op7_mixing": ("mixing", "OP7_SQL"),
    "op11_line_dedup": ("linededup", "OP11_SQL"),
    "op12_prefix_trie": ("prefixtrie", "OP12_SQL"),
    "op13_filter_audit": ("audit", "OP13_SQL"),
}


def _late(name: str, module: str):
    def query(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    query.__name__ = name
    return query


def queries() -> dict:
    return {name: _late(name, module) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, (module, constant) in _SQL.items():
        found[name] = getattr(import_module(f"{__package__}.{module}"), constant)
    return found
