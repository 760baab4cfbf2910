"""All queries of the core library."""

from __future__ import annotations

from speechlytics.plans.identities import identities
from speechlytics.plans.integrity import integrity
from speechlytics.plans.judges import judges
from speechlytics.plans.latency import latency
from speechlytics.plans.records import records
from speechlytics.plans.registry import Registry
from speechlytics.plans.streams import streams

catalog = Registry().merge(integrity, latency, judges, identities, streams, records)
