"""Shared plan plumbing: sessions, tables written to the cluster's shared folder."""
