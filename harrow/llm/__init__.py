"""Operators of a training-data pipeline; nothing else in Harrow imports this subpackage."""
