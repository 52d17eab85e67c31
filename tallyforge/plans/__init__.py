"""Modules that register queries when imported."""

from tallyforge.plans import aggregates, evaluation, extraction, gates, gold, governance, joins, parsed, quality, reports, retrieval, scalars, scope, series, silver, streams, texts, tools  # noqa: F401
