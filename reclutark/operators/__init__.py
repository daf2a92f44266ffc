"""Reusable DataFrame operators: spines, windows, pivots with totals, overlays, table views."""
