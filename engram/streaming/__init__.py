"""Structured Streaming: windows over events, the ordered state of reviewers, result journals."""
