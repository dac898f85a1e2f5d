"""Where the school tables come from and where alerts go."""
