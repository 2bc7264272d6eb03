"""Sources of the vessel-traffic engine."""
