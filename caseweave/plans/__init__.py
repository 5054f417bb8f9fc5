"""Plan-level helpers: cutting lineage, checked broadcasts, ordered ranks."""
