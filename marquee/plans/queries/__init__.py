"""Registered queries by inventory group; importing the package fills the registry."""

from marquee.plans.queries import (  # noqa: F401
    aggregates, contracts, extraction, filters, functions, incremental, joins, quality, sorts_sets, sources, windows,
)
