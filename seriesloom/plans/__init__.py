"""plans of seriesloom."""
