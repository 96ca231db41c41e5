"""All queries: importing this module registers them."""

from talweg.plans import activity, checks, columns, labels, records, relational, scoring, stateful, stores, texts  # noqa: F401
from talweg.plans.registry import ORACLES, QUERIES  # noqa: F401
