"""Generic superstep plans."""
