"""All registered queries."""

from flaskmill.plans import chemistry, curation, ingest, rendering, scoring, similar  # noqa: F401
from flaskmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
