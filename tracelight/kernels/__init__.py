"""Sequential and iterative numerics on arrays. No Spark here."""
