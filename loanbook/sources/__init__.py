"""Where lending tables come from and go to."""
