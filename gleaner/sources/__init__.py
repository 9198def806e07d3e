"""Tables in, tables and reports out."""
