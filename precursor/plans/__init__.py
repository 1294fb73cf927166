"""Plans: analysis configuration, the multi-target pipeline and the report tables."""
