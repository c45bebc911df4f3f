"""Checks on SQL text before anything runs."""
