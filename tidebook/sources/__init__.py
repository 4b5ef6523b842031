"""Where market data comes from and where results go."""
