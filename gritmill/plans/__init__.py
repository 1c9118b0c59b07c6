"""Registered queries: name -> callable(spark, sf_dir), and name -> SQL twin."""
