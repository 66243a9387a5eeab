"""Whole evaluation flows put together from the operators."""
