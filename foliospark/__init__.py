"""foliospark: document analytics as DataFrame, SQL and Structured Streaming operators."""
