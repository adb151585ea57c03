"""Sources and sinks: files, conversations, code-property graphs, the graph store."""
