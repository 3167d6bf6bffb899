"""Composed reports (R1-R8) and model operators (M1-M7)."""
