"""Bounded and resumable streams."""
