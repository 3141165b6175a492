"""Grid analytics on PySpark: raster relations, operators, plans and streams."""
