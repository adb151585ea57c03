"""graphquarry: knowledge-graph analytics over documents, code and conversations, as PySpark plans."""

__version__ = "0.1.0"
