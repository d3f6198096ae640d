"""Operators of a training-data pipeline. Nothing else in paceline imports this subpackage."""
