"""Registered queries: one per operator, with an oracle text where SQL can say it."""
