"""All registered queries and their SQL."""

from __future__ import annotations

from sessionloom.plans import compositions, events, features, graphs, hierarchies, maintenance, search, spaces, streams  # noqa: F401
from sessionloom.plans.registry import ORACLES, QUERIES  # noqa: F401

SMOKE_DIR = "/root/testdata/sf0.001"
