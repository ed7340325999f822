"""Operators for preparing training text. Nothing outside this folder imports it, save the entry module, which works without it."""
