"""Descriptors and geometry as Column and DataFrame expressions, without Python on the executors."""
