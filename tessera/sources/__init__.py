"""Where triples come from: N-Triples text, a direct mapping of relational Parquet tables, stored partitions."""
