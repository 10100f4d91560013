"""Operators for preparing training text. Nothing else in skein imports this subpackage."""
