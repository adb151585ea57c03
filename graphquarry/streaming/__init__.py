"""Structured Streaming over time-stamped mentions and claims (an extension: nothing in the model needs it)."""
