"""functions of barlight."""
