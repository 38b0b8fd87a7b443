"""The queries the driver runs, and the same questions in SQL."""
