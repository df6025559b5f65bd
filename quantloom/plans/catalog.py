"""Imports every plan module so that the registry is complete."""

from quantloom.plans import data, features, modelling, refresh, reports, research, streams  # noqa: F401
from quantloom.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
