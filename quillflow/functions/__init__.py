"""Column functions: text canonicalisation, metrics, scoring."""
