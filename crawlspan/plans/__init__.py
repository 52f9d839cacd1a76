"""Registered queries: composed plans with their SQL equivalents."""
