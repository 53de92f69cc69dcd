"""tallyforge: document-to-ledger analytics written as Spark DataFrame programs."""
