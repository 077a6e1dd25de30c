"""Tables the operators run on, and the catalogue of registered queries."""
