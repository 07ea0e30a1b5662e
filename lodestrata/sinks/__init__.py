"""Writers: published tables, delivery formats and small files."""
