"""Readers, writers and layout changes between rasters and pixel tables."""
