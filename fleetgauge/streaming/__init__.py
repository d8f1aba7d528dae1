"""fleetgauge streaming."""
