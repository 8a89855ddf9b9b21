"""functions of the document-segment engine."""
