"""fleetgauge sources."""
