"""SQL that states the expected rows of the registered queries."""

from . import queries  # noqa: F401
from .registry import ORACLES

__all__ = ["ORACLES"]
