"""The batch rules on streams."""
