"""Operators over nodes, edges, postings, vectors, claims and code-property graphs."""
