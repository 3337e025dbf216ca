"""Plans over whole decrees, and the inputs of the registered queries."""
