"""Typed expressions and the scalar functions."""
