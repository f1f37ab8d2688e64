"""Registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and, for the
value-checkable ones, ``ORACLE_SQL[name]`` -- independent DuckDB SQL over the
same parquet tables. Importing this package registers every query.

Outputs are flat: ids as bigint, doubles rounded, lists joined into strings or
exploded to ``(key, pos, value)`` rows, so both sides hash alike. DuckDB's
``round`` keeps a negative zero that Spark's decimal rounding does not, so
every rounded value in the SQL gets ``+ 0.0``.
"""

from corpusmap.plans.queries.base import ORACLE_SQL, QUERIES, register  # noqa: F401
from corpusmap.plans.queries import embedding, ingest, maps, store, text, vectors  # noqa: F401,E402
