"""arborlens: repository analytics on Spark (scan, dependencies, rules, digests)."""

__version__ = "0.1.0"
