"""Registered queries and the adapters that feed them."""
