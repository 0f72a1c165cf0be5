"""All queries; importing the modules registers them."""

from lexigrain.plans import (  # noqa: F401
    baseline,
    evaluation_queries,
    feature_queries,
    label_queries,
    model_queries,
    stat_queries,
    text_queries,
    tree_queries,
)
from lexigrain.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
