"""Composite operators (L1-L9) and the registered query catalog."""
