"""Landed files as flat tables."""
