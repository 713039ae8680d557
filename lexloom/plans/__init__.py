"""Plan-level helpers: shared intermediate tables, bounded broadcasts, graph fixpoints."""
