"""Scalar functions as Spark columns: text, URLs, dates, scores, JSON. Built-ins wherever they can express the rule."""
