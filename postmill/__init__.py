"""Posting analytics on Spark: dedup, history, extraction, voting, matching, digests, scoring."""
