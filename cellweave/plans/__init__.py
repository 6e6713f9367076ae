"""Typed operator graphs compiled to lazy plans, and the registered queries."""
