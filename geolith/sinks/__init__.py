"""Output formats and stores."""
