"""Readers and writers for audit logs, rule tables and traffic reports."""
