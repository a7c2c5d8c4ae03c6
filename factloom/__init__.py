"""factloom: analytic queries over facts about a codebase, as Spark DataFrames."""
