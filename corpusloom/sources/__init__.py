"""Where corpora and responses come from, and where results go."""
