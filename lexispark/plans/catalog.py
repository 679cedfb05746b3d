"""All registered queries."""

from lexispark.plans import (  # noqa: F401
    catalog_assess,
    catalog_corpus,
    catalog_features,
    catalog_learning,
    catalog_sources,
    catalog_text,
)
from lexispark.plans.registry import ORACLES, QUERIES  # noqa: F401
