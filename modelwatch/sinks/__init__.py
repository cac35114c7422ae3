"""Append-only fact sinks, full-refresh sinks and guards."""
