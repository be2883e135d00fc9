"""Compositions of operators: the batch jobs."""
