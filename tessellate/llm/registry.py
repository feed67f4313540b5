"""All registered queries of the subpackage and their oracle SQL."""

from . import byte_bpe, conversation_repair, html_extraction, language_id, near_dedup, packing, quality_rules, spelling_groups, token_counts, token_files, top_k, toxicity, warc

MODULES = [token_files, near_dedup, byte_bpe, quality_rules, warc, toxicity, token_counts, packing, top_k, language_id, html_extraction, conversation_repair, spelling_groups]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
