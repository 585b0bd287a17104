"""Training-data operators: near-duplicate search, text classifiers, tokenization, archives, chat rendering."""
