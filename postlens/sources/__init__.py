"""Readers and writers: test tables, fixture views, the posts store, files, pages."""
