"""Job-postings analytics on Spark: ingest, column functions, operators and reports."""
