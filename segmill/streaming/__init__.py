"""streaming of the document-segment engine."""
