"""Queries of the core, by name, and their SQL counterparts."""
