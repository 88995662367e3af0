"""Structured Streaming jobs for the work the batch side polls for."""
