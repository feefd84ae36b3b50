"""Receipt analytics on Spark: ingest, parse, check, flatten and aggregate point-of-sale receipts."""
