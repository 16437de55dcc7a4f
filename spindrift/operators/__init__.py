"""spindrift.operators."""
