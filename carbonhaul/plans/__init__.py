"""Measures, time intelligence, scenarios and replacement planning."""
