"""Bitmaps as rows: a floor of any size is a table of pixels or runs, never an array in one task."""
