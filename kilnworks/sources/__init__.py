"""Readers and writers for logs, build documents, test reports and the history store."""
