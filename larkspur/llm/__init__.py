"""Operators that prepare training text; nothing else in the library imports this subpackage."""
