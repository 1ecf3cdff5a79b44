"""Scans of landed tables and the tables and files the engine publishes."""
