"""Complete queries over the driver's tables, and the facade functions."""
