"""Readers and writers: file scans, JSON labels, packed and top-k tables, reports."""
