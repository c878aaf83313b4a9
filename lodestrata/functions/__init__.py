"""Column functions and vectorised codecs."""
