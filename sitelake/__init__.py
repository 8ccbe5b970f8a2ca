"""sitelake: site-catalog and document analytics as PySpark DataFrame jobs."""
