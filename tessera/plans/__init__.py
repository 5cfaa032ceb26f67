"""Registered queries, by family."""

from . import bandcharts, collection, decimals, discovery, evidence, formulas, graphs, growth, mapping, narrative, official, periods, pointintime, ranking, relational, reporting, sheets, sources, streams, texts, validation, workspace  # noqa: F401
