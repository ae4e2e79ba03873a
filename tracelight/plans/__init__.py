"""Declared analyses: specifications, validation, execution and multiverses."""
