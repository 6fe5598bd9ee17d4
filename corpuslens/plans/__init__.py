"""What persists between queries: caches, stores, metrics."""
