"""Streams of operator events: windowed counts, latest states and running readiness."""
