"""Query plans composed of operators, by name."""

from siftwork.plans import contracts, evaluation, integrity
from siftwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "contracts", "evaluation", "integrity"]
