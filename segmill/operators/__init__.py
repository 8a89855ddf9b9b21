"""operators of the document-segment engine."""
