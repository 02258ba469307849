"""Operators of a training-data pipeline; each works on whole tables and keeps its own general interface."""
