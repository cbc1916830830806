"""Readers for logs, older flat tables and trusted ranges."""
