"""Structured Streaming: event windows and searches over arriving lines."""
