"""Plans: builds composed from operators, and the registered queries."""
