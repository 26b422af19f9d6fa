"""Sources and sinks: Parquet graph tables, source trees, build files."""
