"""Column functions and presets."""
