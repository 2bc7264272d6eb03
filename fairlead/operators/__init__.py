"""Operators of the vessel-traffic engine."""
