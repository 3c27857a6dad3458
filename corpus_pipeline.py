"""From raw ``documents`` to packed training windows. Counted as part of ``signalgraph.llm``."""

from __future__ import annotations

from signalgraph.llm import common as C
from signalgraph.llm.pipeline import STAGES

#: No SQL engine tokenizes or estimates robust covariances; tests/llm holds each stage against plain loops.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Every stage in turn, each result written to the shared folder and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.settle(stage(spark, docs, sf_dir), name)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
