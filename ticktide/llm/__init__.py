"""Operators for preparing training text; nothing else in ticktide imports this subpackage."""
