"""Sources and sinks: parquet tables, CSV exports, split tables, metric files."""
