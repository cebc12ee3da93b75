"""Operators for training text: leaked evaluation items, mixing sources, sentence boundaries."""
