"""End-to-end listing flows: compositions of the operators (group P)."""
