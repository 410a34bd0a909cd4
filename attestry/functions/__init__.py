"""Column builders; each is used by jobs over whole tables."""
