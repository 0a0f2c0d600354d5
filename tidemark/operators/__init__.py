"""What changes a table or reads its history: row mutations, catalog changes, the change feed and maintenance."""
