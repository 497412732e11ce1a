"""Operators for training-data curation. Nothing outside this subpackage imports it."""
