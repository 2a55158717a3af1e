"""The operators, one module for each family."""
