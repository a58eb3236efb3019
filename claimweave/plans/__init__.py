"""Bindings of the generic operators to concrete tables, with their SQL oracles."""
