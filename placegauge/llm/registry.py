"""All queries of this subpackage, the pipeline with them, and their SQL."""

import corpus_pipeline
from placegauge.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = dict(queries.ORACLES)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
