"""Stage plans composed of the operators, and the registry of queries."""
