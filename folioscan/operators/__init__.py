"""DataFrame operators: fields, postings, predicates, ranking, upsert and maintenance."""
