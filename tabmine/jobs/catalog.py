"""All named queries."""

from tabmine.jobs import bayes, distributions, evaluation, ingest, machines, models, neighbours, profiling, selection  # noqa: F401  each registers its queries
from tabmine.jobs.registry import ORACLE_SQL, QUERIES  # noqa: F401
