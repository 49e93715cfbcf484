"""An engine for RDF graphs on Spark: sources, schema statistics, partitioned stores, and SPARQL basic graph patterns."""
