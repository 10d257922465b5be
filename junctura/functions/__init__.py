"""Part of the junctura package."""
