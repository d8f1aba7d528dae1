"""fleetgauge operators."""
