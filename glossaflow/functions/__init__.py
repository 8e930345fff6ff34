"""Column functions; all native unless they say otherwise."""
