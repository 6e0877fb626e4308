"""All queries of this subpackage."""

from postloom.llm import ann, balltree, infill, jaccard, linededup, mixing, pieces, quality, sharding, tokencounts, topk, urlgraph, warc  # noqa: F401
from postloom.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
