"""Readers for readings, alert logs and measured runs."""
