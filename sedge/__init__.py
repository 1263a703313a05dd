"""Part of the sedge engine."""
