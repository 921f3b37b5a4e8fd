"""operators of barlight."""
