"""Structured Streaming: windowed counts with watermarks, deduplication and upserts by batch."""
