"""Where rows live: versioned Parquet tables, the catalog, indexes, transactions and the client."""
