"""Reading source tables, shaping them into documents, and paging by key."""
