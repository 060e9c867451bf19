"""All queries of the general operators, and their SQL."""

from __future__ import annotations

from millrace.plans import field_queries, relational_queries, stat_queries

QUERIES = {**relational_queries.QUERIES, **stat_queries.QUERIES, **field_queries.QUERIES}
SQL = {**relational_queries.SQL, **stat_queries.SQL, **field_queries.SQL}
