"""Whole jobs: copy a table, prepare targets, run a migration, export a script."""
