"""Streaming forms of segmentation and upserts."""
