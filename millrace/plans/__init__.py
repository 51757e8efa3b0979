"""Names for sources, stored queries and collections."""
