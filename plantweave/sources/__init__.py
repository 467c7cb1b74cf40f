"""Inputs and outputs: documents, rules and keyed tables."""
