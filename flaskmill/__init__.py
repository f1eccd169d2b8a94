"""flaskmill: reaction-corpus curation and ranked-prediction scoring on Spark DataFrames."""
