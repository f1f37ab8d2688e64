"""The query registry (kept for imports): see ``corpusmap.plans.queries``."""

from corpusmap.plans.queries import ORACLE_SQL, QUERIES, register  # noqa: F401
