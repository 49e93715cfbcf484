"""From SPARQL text to join plans."""
