"""Column functions: text, lexicon, rules, pairs, JSON."""
