"""Every operator as a named query over the test tables, with its SQL twin."""

from tauframe.plans.catalog import evaluation, models, preparation, statistics, trees
from tauframe.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "models", "preparation", "statistics", "trees"]
