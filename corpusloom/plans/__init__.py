"""Named queries over the tables, and the same in DuckDB SQL."""

from corpusloom.plans import preparation  # noqa: F401 - registers its queries
from corpusloom.plans.oracle import ORACLE_SQL
from corpusloom.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
