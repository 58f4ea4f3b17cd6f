"""Cohort-risk analytics as Spark DataFrame operators.

``sources``    table and document readers, and the adapter from the test tables
``functions``  column expressions (no UDFs)
``operators``  DataFrame -> DataFrame operators
``plans``      whole reports and training runs put together from operators
``streaming``  the same scoring and audit steps on an unbounded input
"""
