"""Crawl-inventory, mirror-reconciliation and corpus operators as Spark jobs."""
