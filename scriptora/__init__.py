"""Text-corpus analytics on Spark: cleaning, script and quality features, language identification, corpus statistics, evaluation."""
