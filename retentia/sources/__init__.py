"""Reading and writing: CSV, tables, order data, scoring requests, staging."""
