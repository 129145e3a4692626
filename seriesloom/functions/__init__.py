"""functions of seriesloom."""
