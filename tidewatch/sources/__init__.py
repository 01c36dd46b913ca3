"""Where series come from and where scores and measures go."""
