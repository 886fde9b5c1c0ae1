"""DataFrame operators: overlap, similarity, style, citations, graphs, detectors and fusion."""
