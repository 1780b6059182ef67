"""plans of the evidence engine: its queries over the driver's tables, and SQL that gives the same rows."""

from veritally.plans import articles, assembly, eligibility, estimates, evidence, leads, ranks, records, reviews, serving, texts, trials, usage

_MODULES = (evidence, records, reviews, usage, eligibility, texts, trials, ranks, serving, articles, estimates, assembly, leads)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
