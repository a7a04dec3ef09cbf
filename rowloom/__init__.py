"""Feature engineering, validation and ensembling for tabular data on Spark."""

from rowloom.layout import Layout

__all__ = ["Layout"]
