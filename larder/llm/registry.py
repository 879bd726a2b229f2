"""Queries of this subpackage and the SQL that checks those that SQL can express."""

import corpus_pipeline
from larder.llm import bpe, forest, langid, licenses, line_dedup, mixing, ngram_join, quality, simhash, spelling, topk, url_filters, whitening

MODULES = [url_filters, topk, langid, line_dedup, forest, bpe, mixing, quality, licenses, simhash, ngram_join, spelling, whitening]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
