"""Registered queries and the SQL that tests compare them with."""
