"""Part of the graphloom engine."""
