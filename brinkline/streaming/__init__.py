"""Streaming forms of block maxima (an extension)."""
