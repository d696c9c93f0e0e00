"""A PySpark engine for corpora of layered page documents."""
