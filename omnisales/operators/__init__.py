"""Reusable Spark operators: ranks, exact tiles, running totals, shares, panels."""
