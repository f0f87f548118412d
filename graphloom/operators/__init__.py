"""Operators over debug entries, types, symbols and names."""
