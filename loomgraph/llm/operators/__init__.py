"""The operators of this package."""
