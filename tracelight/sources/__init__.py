"""Readers into the canonical tables and writers of evidence."""
