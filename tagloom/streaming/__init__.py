"""The row-local edits on streams."""
