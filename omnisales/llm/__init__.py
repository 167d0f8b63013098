"""Operators for preparing large training corpora on Spark. Nothing else in the library imports this package."""
