"""Column functions: identifiers, bibliographic text, numbers and decisions."""
