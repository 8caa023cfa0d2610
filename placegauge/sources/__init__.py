"""Reading landed files and catalogs, writing result tables."""
