"""spindrift.functions."""
