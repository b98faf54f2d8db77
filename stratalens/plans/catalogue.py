"""All registered queries; importing this module fills the registry."""

from stratalens.plans import catalogue_arrays, catalogue_detection, catalogue_fourier, catalogue_labels, catalogue_metrics, catalogue_more, catalogue_nd, catalogue_patches, catalogue_records, catalogue_streams, catalogue_tables, catalogue_tiled, catalogue_traced  # noqa: F401
from stratalens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
