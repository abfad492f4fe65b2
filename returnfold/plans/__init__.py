"""Reports and data for charts, put together from the operators."""
