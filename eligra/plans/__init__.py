"""Registered queries: each operator over the driver's tables, with its SQL counterpart."""

from __future__ import annotations


def all_queries() -> dict:
    """Every registered query by name."""
    from eligra.plans import cleaning, evaluation, graphs, matching, modeling, reports, texts

    found: dict = {}
    for module in (cleaning, matching, evaluation, graphs, texts, modeling, reports):
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found
