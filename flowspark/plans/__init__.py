"""Adapters from the test tables and the registered queries built on them."""

from importlib import import_module

MODULES = ["rule_queries", "flow_queries", "metric_queries", "analyze_queries", "clean_queries", "model_queries", "file_queries", "store_queries",
           "report_queries"]


def load_queries():
    """(queries, oracles) of every query module."""
    for name in MODULES:
        import_module(f"flowspark.plans.{name}")
    from flowspark.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
