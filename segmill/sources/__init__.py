"""sources of the document-segment engine."""
