"""DataFrame operators: chunking, retrieval, metrics, statistics, comparison."""
