"""Registered queries over the adapter tables."""

from . import q_catalogue, q_files, q_images, q_orders, q_strata  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
