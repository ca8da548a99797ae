"""Compositions of operators into complete jobs."""
