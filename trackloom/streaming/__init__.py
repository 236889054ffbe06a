"""The same folds and flows as Structured Streaming queries."""
