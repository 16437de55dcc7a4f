"""spindrift.streaming."""
