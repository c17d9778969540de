"""Importing the modules registers their queries."""

from . import fleet, insight, intake, planning, scenario, telemetry  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
