"""Where archive tables come from and go to."""
