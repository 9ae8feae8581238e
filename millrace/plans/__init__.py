"""The fluent builder, named subplans, and variants of one plan."""

from millrace.plans.builder import Query
from millrace.plans.program import Program

__all__ = ["Program", "Query"]
