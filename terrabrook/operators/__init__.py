"""DataFrame operators on scenes, pixels and rasters."""
