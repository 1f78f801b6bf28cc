"""Registered queries: the operators over the given tables, each with SQL it must agree with."""

from photolake.plans import q_posts, q_images, q_boxes, q_metadata, q_search, q_collect, q_decode  # noqa: F401
from photolake.plans.registry import ORACLES, QUERIES  # noqa: F401
