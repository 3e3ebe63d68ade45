"""Reusable DataFrame operators: keyed lookups, distributed ordering, intervals, sweeps, ROC, 2x2 tables."""
