"""cordon.functions."""
