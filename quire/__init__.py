"""A PySpark engine for corpora of structured documents."""
