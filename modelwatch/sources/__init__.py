"""Scans with explicit schemas."""
