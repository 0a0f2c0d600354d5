"""Planning on metadata: which files can hold rows that match a predicate."""
