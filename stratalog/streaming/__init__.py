"""Counters over event streams."""
