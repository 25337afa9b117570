"""Continuous versions of the feature, decision and report operators."""
