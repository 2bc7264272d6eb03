"""Plans of the vessel-traffic engine."""
