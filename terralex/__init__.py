"""terralex: spatial, graph and text-resolution operators for PySpark."""
