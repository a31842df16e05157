"""Training-data operators: joins, tokenization, contamination, licences, quality, sharding, classifiers, secrets."""
