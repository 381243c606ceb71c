"""Iterative work: driver loops whose every turn is one or two DataFrame jobs."""
