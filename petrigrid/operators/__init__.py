"""Relational, spatial, statistical and pixel-table operators (DataFrame in, DataFrame out)."""
