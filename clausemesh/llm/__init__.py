"""Operators for preparing training text: one module each, plus their registered queries."""
