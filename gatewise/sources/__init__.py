"""Sources: camera registry, settings files, labels, JPEG byte streams."""
