"""operators of seriesloom."""
