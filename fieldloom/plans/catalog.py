"""Every registered query."""

from fieldloom.plans import (  # noqa: F401
    catalog_fitting,
    catalog_metrics,
    catalog_records,
    catalog_runs,
    catalog_sampling,
    catalog_schema,
    catalog_scoring,
    catalog_sources,
)
from fieldloom.plans.registry import ORACLES, QUERIES  # noqa: F401
