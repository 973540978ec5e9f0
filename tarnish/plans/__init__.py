"""All registered queries of the library but those of its training-data subpackage."""

from tarnish.plans import analysis, console, derived, packages, scripts, staged, streams  # noqa: F401
from tarnish.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
