"""Column expressions over features: geometry, tags and text."""
