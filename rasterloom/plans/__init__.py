"""Plans that bind tables to the domain: adapters, and the queries that operators are registered as."""
