"""Mart, reports, checks and table-lifecycle operators."""
