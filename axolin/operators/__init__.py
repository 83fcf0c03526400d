"""Relational operators on vectors and matrices."""
