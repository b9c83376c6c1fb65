"""Every query of the engine by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pulsegrid.plans import activity, checks, entities, forecasts, ingestion, relational, resolution, scalars, series, store, streams

MODULES = [activity, series, relational, scalars, entities, resolution, store, checks, ingestion, forecasts, streams]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    if clash := QUERIES.keys() & _module.QUERIES.keys():
        raise ValueError(f"queries registered twice: {sorted(clash)}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
