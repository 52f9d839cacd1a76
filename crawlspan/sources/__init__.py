"""Readers and writers for crawl files, tweets, dictionaries and graphs."""
