"""Operators for preparing training text; nothing else in inkgrove imports this subpackage."""
