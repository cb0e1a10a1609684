"""Recipes (replayable step lists) and sheet sessions (versioned tables)."""
