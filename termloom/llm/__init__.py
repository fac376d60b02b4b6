"""Operators for preparing training data. Nothing else in termloom imports this package."""
