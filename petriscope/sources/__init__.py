"""Readers: file listings, images, masks, polygons, boxes, catalogs."""
