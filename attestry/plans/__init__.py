"""Jobs composed of others."""
