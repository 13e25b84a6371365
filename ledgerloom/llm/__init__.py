"""Operators of a training-data pipeline. Nothing else in ledgerloom imports this subpackage."""
