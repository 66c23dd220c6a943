"""Column expressions: text clean-up, identity keys, thresholds."""
