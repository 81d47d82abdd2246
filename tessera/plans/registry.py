"""All queries of the library and their SQL."""

from tessera.plans import fact_oracles, intake_oracles, intake_queries, market_oracles, oracles, research_oracles, research_queries  # noqa: F401  the query modules add their own
from tessera.plans.catalogue import QUERIES

SQL = oracles.SQL | research_oracles.SQL | intake_oracles.SQL | fact_oracles.SQL | market_oracles.SQL
