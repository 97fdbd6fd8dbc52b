"""The registered queries and the SQL each one must agree with."""
