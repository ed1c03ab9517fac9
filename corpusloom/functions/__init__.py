"""Row-local column functions; all of them also work on a streaming DataFrame."""
