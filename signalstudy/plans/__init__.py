"""Plans: whole studies, their configuration, cache, outputs and query catalogue."""
