"""Readers and writers of the formats that data comes in and results leave in."""
