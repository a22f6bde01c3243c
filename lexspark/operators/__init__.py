"""Plans over whole tables, made of the functions."""
