"""All registered queries. Importing the modules fills the registry."""

from spendlake.plans import analytics, categorize, ingest, insights, streams, text, transactions  # noqa: F401
from spendlake.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
