"""Part of the cohort analytics library."""
