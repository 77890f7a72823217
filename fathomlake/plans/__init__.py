"""Formulas and their compilation to plans."""
