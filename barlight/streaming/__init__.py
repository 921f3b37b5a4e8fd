"""streaming of barlight."""
