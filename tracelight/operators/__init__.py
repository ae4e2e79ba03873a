"""Operators on the canonical tables; each is a DataFrame plan unless its module says otherwise."""
