"""Study-level compositions of the operators."""
