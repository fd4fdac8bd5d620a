"""cordon.streaming."""
