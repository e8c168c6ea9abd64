"""rewritelab: measuring and curating text rewrites as Spark DataFrame pipelines."""
