"""Dayglass: features, scoring and evaluation for impression logs that are split by day."""
