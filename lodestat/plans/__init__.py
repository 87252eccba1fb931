"""Registered queries and multi-step plans."""
