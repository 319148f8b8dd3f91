"""votecount: vote-tally analytics on Spark DataFrames."""
