"""Where documents come from and go to, and the calls to services."""
