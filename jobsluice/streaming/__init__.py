"""The incremental run as a Structured Streaming job."""
