"""Operators of an event study."""
