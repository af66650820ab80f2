"""Registered queries of the core engine and their SQL."""

from . import container_plans, keypoint_plans, matcher_plans, metric_plans, patch_plans, pixel_plans, retrieval, stream_plans  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
