"""Operators of a training-data pipeline over ``documents`` and its companion tables.

Nothing else in the library imports this folder.
"""
