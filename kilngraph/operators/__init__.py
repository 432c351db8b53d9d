"""DataFrame operators: chunking, extraction, linking, normalisation, graph, queries, formulation, questions."""
