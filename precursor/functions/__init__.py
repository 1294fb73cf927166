"""Column functions: payload extraction, criteria algebra, text normalisation."""
