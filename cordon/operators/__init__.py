"""cordon.operators."""
