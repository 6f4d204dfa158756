"""Array kernels, and the operators that run them over rows of images and objects."""
