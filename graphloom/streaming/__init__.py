"""Units as a stream."""
