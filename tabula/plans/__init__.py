"""Query construction and the catalogue of ready-made queries."""
