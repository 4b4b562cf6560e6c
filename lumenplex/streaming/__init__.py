"""Structured Streaming forms of the jobs: extensions, since a stack may arrive field by field."""
