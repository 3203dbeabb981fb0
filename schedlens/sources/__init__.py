"""Sources and sinks: trace CSV ingest, Parquet store, driver-table views."""
