"""segmill: a PySpark engine for document segments: classify, match, translate, check and assemble."""
