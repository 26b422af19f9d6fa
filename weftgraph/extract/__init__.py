"""Source files to nodes and edges: lexers, acceptors, extractors."""
