"""Operators of the algebra, as functions from relations to relations."""
