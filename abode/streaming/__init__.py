"""Structured Streaming jobs: continuous scoring (N1) and windowed drift."""
