"""Readers and writers: project folders, images, summary CSV, reports."""
