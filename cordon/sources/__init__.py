"""cordon.sources."""
