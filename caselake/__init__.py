"""caselake: document and case-register analytics as PySpark DataFrame operators."""
