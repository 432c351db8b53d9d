"""Named plans: the operators bound to relational tables, each with an independent SQL form."""
