"""skein: mining of large categorical matrices and noisy sequences on Spark DataFrames."""
