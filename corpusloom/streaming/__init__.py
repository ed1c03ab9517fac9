"""The row-local steps on a stream of files or responses."""
