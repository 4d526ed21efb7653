"""Operators for training text: noise, markup, look-alikes, cuts, leaks, mixing, shared spans.

Nothing outside this package imports it.
"""
