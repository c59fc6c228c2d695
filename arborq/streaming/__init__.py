"""Change feeds and state over streams."""
