"""Reusable plan shapes: grid joins, chunked ranks, exact quantiles, bounded iteration."""
