"""Bindings of the operators to the driver tables."""
