"""Every named query of the engine; importing the modules registers them."""

from . import book, components, criticality, events, files, folds, joins, layers, linear, market, regressions, scores, series, states, stats, stream, studies, tables, text, validation
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "book", "components", "criticality", "events", "files", "folds", "joins", "layers", "linear", "market", "regressions", "scores", "series", "states", "stats", "stream", "studies", "tables", "text", "validation"]
