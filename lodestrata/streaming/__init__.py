"""Streaming forms of the censuses: an extension, as archives themselves are finite."""
