"""Typed-graph and relational analytics on Spark."""
