"""Registered queries and pipelines composed of the operators."""
