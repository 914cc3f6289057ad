"""Whole plans: the posting view over the test tables, the daily run, the named queries."""
