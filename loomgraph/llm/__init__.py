"""Operators on training text: source files, credentials, leaks, mixtures and spam. Nothing outside imports this package."""
