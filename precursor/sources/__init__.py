"""Readers of the native tables, the test-data adapter and the materialisation cache."""
