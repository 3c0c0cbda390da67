"""Incremental decoding and writing, and Structured Streaming over both."""
