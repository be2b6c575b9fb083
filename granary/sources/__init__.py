"""CSV, text and parquet sources, presets and sinks."""
