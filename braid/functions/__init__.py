"""Part of the braid analytics engine."""
