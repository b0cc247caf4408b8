"""Relational operators of the covariance engine."""
