"""Readers for raw market files and the fixture views over the driver's tables."""
