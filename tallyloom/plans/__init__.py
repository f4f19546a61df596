"""Registered queries of the library, each with the SQL that states it."""

from tallyloom.plans import aggregate, explore, identity, survey, text
from tallyloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregate", "explore", "identity", "survey", "text"]
