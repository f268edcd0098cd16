"""Registered queries over the test tables, each next to its SQL twin."""

from vitrine.plans import (  # noqa: F401
    q_aggregates, q_baskets, q_categories, q_columns, q_rules, q_sources, q_texts, q_trends,
)
from vitrine.plans.registry import ORACLES, QUERIES  # noqa: F401
