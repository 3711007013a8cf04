"""Registered queries. ``code`` adds its queries to the registry."""

from quillgraph.plans import code  # noqa: F401
