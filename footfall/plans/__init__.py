"""Jobs that combine operators: ingest, nightly tables, export."""
