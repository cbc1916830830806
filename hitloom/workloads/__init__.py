"""Inputs derived from the test tables, and the checked queries over them."""
