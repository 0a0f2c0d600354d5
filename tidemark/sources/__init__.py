"""Reading and writing the files of a table."""
