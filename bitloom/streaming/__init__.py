"""Chunks, blocks and streams."""
