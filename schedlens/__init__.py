"""schedlens: cluster-scheduler trace analytics on the PySpark DataFrame API.

Layout
------
``schemas``      typed nested tables of the trace data model (structs, enums, constants)
``functions``    column expressions: saturating time arithmetic, buckets, struct merge
``sources``      CSV ingest, Parquet store, views over the driver's test tables
``operators``    as-of joins, consolidation, weighted percentiles, utilisation,
                 machine usage, priority series, sampling, exports
``plans``        the import / summaries / export pipelines and the query registry
"""

__version__ = "0.1.0"
