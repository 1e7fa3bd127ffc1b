"""Retail behaviour analytics as plain PySpark DataFrame functions.

Layers, from the wire inwards:

``sources``    Kafka and file readers, the JSON codec, stored result tables
``functions``  column expressions shared by the operators
``operators``  live metrics, windowed roll-ups and read-side reports
``streaming``  sinks, triggers and checkpoint locations
``plans``      session settings, the continuous application, the query catalog
"""
