"""Operators: similarity join, graph algorithms, coverage reports and exports."""
