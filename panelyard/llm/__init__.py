"""Operators for training-data corpora: scans, duplicates, classifiers, placement, encoding."""
