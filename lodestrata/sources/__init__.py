"""Sources: disc images, archive indexes and ranged reads."""
