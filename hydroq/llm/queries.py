"""All queries of this subpackage and the pipeline."""

import importlib

from hydroq.llm.catalog import ORACLES, QUERIES  # noqa: F401

MODULES = ("suffix_dedup", "line_dedup", "decontaminate", "url_filter", "embeddings", "pieces", "language", "simhash", "quality", "class_lm", "line_rules", "centroids", "conversations")

for _name in MODULES:
    importlib.import_module(f"hydroq.llm.{_name}")

import corpus_pipeline  # noqa: E402

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
