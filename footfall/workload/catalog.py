"""Imports every query module, so that the registry is complete."""

from footfall.workload import accounts, behaviour, ingest, longterm, metrics  # noqa: F401
from footfall.workload.registry import ORACLES, QUERIES  # noqa: F401
