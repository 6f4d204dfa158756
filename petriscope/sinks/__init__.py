"""Writers: tables, arrays, JSON, images, Zarr."""
