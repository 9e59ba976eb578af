"""Character classes, code tables and scalar expressions."""
