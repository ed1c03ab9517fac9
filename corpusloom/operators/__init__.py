"""DataFrame to DataFrame operators keyed by ``repo``."""
