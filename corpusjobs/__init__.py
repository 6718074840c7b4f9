"""corpusjobs: Spark jobs that build, index, search and prove text corpora."""
