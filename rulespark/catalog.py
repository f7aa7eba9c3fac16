"""The registered queries and their SQL."""

from rulespark.queries import ORACLE_SQL, QUERIES, aggregates, functions, incremental, recursion, relational, sqlviews  # noqa: F401
