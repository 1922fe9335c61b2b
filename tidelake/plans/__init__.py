"""Planning of ingestion work."""
