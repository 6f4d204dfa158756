"""The same transformations on streams of arriving files."""
