"""Operators of a training-data pipeline, their queries and oracle SQL."""
