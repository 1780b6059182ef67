"""operators of the evidence engine."""
