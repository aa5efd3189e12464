"""Named plans: the queries over the Parquet tables, with their SQL."""
