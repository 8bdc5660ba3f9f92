"""Column functions: boxes, draws, text, regions and ink."""
