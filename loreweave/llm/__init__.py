"""Operators for preparing training text at cluster scale.

Nothing outside this folder imports it.
"""
