"""All queries outside the text pipeline, with their SQL."""

from __future__ import annotations

from loamline.plans import app, collection, curation, evaluation, event_series, gait, provenance, records, triage

QUERIES = {**curation.QUERIES, **evaluation.QUERIES, **event_series.QUERIES, **triage.QUERIES, **provenance.QUERIES, **gait.QUERIES, **records.QUERIES, **collection.QUERIES, **app.QUERIES}
ORACLES = {**curation.ORACLES, **evaluation.ORACLES, **event_series.ORACLES, **triage.ORACLES, **provenance.ORACLES, **gait.ORACLES, **records.ORACLES, **collection.ORACLES, **app.ORACLES}
