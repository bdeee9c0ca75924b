"""Operators of training-data pipelines for language models; nothing outside this folder imports it."""
