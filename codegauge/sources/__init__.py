"""Readers and writers of files, requests, results, snapshots and metric text."""
