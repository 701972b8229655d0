"""The queries of this subpackage, and the SQL of those that SQL can express."""

from gradewise.llm import bpe, collocations, infill, license_scan, line_dedup, packing, piece_codec, quality, secret_scan, simhash, token_counts, top_k, warc

MODULES = (license_scan, top_k, token_counts, line_dedup, simhash, secret_scan, warc, quality, packing, bpe, collocations, piece_codec, infill)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
