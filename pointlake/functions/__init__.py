"""Column functions: geography, geometry, colour and tag rules."""
