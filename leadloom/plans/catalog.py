"""Importing this module registers every query."""

from leadloom.plans import ads, clusters, contacts, files, intent, reports, streams  # noqa: F401

FLAGSHIP = "scr22_rescore_all"
