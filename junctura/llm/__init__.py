"""Operators for preparing training corpora; nothing outside this subpackage imports it."""

from __future__ import annotations

from . import language_crf, lexical_index, license_scan, merkle, minhash_forest, mixing, piece_bpe, quality_rules, repeats, token_automaton, toxicity, transport_stream, warc

_MODULES = (quality_rules, repeats, mixing, license_scan, piece_bpe, toxicity, transport_stream, warc, language_crf, minhash_forest, token_automaton, lexical_index, merkle)


def queries():
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in _MODULES if getattr(m, "ORACLE_SQL", None)}
