"""Whole jobs and the registry of queries."""
