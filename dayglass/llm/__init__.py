"""Operators for training data: fingerprints, scans, classifiers, joins, scoring, tokens."""
