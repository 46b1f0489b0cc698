"""Distributed operators over the retail tables."""
