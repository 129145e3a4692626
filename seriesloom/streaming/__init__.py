"""streaming of seriesloom."""
