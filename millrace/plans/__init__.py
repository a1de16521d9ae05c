"""Flow specifications and the one path that runs them."""
