"""spindrift.sources."""
