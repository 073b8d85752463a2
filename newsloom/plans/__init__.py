"""Whole jobs and the serving queries, composed from operators."""
