"""Dataset loaders and the table store."""
