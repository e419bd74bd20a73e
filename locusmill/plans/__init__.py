"""Building blocks shared by the operators and the registered queries."""
