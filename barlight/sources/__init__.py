"""sources of barlight."""
