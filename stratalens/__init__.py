"""stratalens: a PySpark-native engine for record, metric and array analytics."""

from stratalens.session import get_spark

__all__ = ["get_spark"]
