"""Queries over the supplied tables, each with the SQL that checks it."""


def load():
    from catalog import construction, alignment, estimation, inference, portfolio, screening, quality  # noqa: F401
    from catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
