"""Where rows come from: the session, parquet tables, small lookup tables."""
