"""Registered queries: every operator applied to the driver tables, with its oracle SQL."""
from importlib import import_module

from .registry import ORACLE, QUERIES

MODULES = ("cleaning", "scalars", "joins", "windows", "aggregates", "reshaping", "constraints", "events", "forecasts", "resampling", "markets", "outages",
           "feeds", "streams", "regimes", "extras")

for _m in MODULES:
    import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "ORACLE"]
