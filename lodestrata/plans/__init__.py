"""Named queries of the core, each with its DuckDB statement where SQL can express it."""
