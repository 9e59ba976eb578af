"""Run extraction, stitching across chunks, and resolution of overlapping readings."""
