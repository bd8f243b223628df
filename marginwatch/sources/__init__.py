"""Table schemas, readers, writers and the star-schema adapter."""
