"""The operators of the library."""
