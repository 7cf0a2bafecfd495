"""Composite plans and the named queries that exercise the operators."""
