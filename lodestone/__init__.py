"""Source repositories, and the corpora made of them, as Spark DataFrames."""
