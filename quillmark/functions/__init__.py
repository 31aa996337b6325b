"""Column functions: text, segmentation and JSON repair."""
