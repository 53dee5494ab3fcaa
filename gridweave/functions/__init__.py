"""Expressions as Spark SQL text.

A row of fifty features is one ``selectExpr`` call: the text is parsed in the JVM, instead of
hundreds of small calls per plan from Python.
"""
