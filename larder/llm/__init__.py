"""Operators for preparing text corpora and vectors at scale, and their queries."""
