"""fleetgauge functions."""
