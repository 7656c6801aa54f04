"""Reading and writing images, vectors and fitted models."""
