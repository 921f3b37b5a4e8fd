"""plans of barlight."""
