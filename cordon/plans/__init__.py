"""cordon.plans."""
