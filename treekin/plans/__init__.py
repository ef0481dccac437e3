"""Plans: pair scores, cohorts, the store."""
