"""The incremental work as streams."""
