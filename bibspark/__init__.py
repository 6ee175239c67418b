"""bibspark: bibliographic corpus analytics and training-data jobs as PySpark DataFrame pipelines."""
