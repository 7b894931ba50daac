"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from . import ann, chat, graph_dedup, html_text, near_dup, packing, pii, quality, secrets, sentencepiece, suffix_dedup, vector_codes

MODULES = (html_text, chat, sentencepiece, pii, quality, secrets, near_dup, packing, ann, graph_dedup, suffix_dedup, vector_codes)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
