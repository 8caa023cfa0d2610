"""Place-score analytics on Spark: catalog selection, facility cleaning, radius counts, scoring."""
