"""Streaming of the vessel-traffic engine."""
