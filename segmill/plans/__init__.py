"""plans of the document-segment engine."""
