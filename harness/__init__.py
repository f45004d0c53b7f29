"""The given tables in the roles of the library, and an SQL check per query."""
