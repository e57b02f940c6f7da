"""Every query of the engine."""

from tessera.operators import ann, answers, build, corpus, crawl, pages, relational, retrieval, terms, textual
from tessera.plans import hooks, jobs, restore
from tessera.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ann", "answers", "build", "corpus", "crawl", "hooks", "jobs", "pages", "relational", "restore", "retrieval", "terms", "textual"]
