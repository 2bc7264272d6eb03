"""Functions of the vessel-traffic engine."""
