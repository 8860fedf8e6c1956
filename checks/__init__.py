"""Loan-shaped views over the driver tables, and the registered queries."""


def _load():
    from checks import registry
    from checks import model_queries, panel_queries, report_queries  # noqa: F401

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
