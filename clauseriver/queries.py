"""All queries of the package with their oracles, by name."""

from clauseriver.operators import detect, evaluate, ground, history, merge, pages, rulebase
from clauseriver.plans import battery, evaluation, pipelines
from clauseriver.streaming import jobs

_MODULES = (pipelines, battery, evaluation, pages, detect, rulebase, ground, merge, evaluate, history, jobs)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
