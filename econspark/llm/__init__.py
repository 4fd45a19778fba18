"""Operators for preparing training text and searching embeddings.

Nothing else in the package imports this folder. Functions that run in tasks are sent by value, so executors need
no copy of the package.
"""
