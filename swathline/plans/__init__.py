"""Whole computations: configured pipelines and the registered queries."""
