"""Column expressions: dates, level thresholds, text clean-up, geometry."""
