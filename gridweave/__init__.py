"""Hourly panel time series on Spark: features, quality checks, scaling, fuzzy regression."""

from gridweave.session import get_session

__all__ = ["get_session"]
