"""Part of the tessel engine."""
