"""Shared session helpers and fixed biological tables."""
