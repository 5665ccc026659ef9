"""Query plans: the projection of the star-schema tables onto event records, and every registered query with its SQL."""
