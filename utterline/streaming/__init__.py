"""Structured Streaming: folders as sources, detection as rows arrive, windowed usage."""
