"""sources of seriesloom."""
