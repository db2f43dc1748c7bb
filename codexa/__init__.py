"""codexa: bibliographic analytics and corpus operators on Spark DataFrames."""
