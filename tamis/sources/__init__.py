"""Where documents, criteria and order lists are read from and written to."""
