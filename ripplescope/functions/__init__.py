"""Part of the change-impact engine."""
