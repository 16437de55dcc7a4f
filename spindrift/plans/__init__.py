"""spindrift.plans."""
