"""Table readers, writers and schema checks."""
